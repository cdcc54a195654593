"""Operator 10 against a search for every wording in every text."""

import random
import time

import pytest

from terrafold.llm import licenses
from terrafold.llm.license_texts import TEMPLATES


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner()


def names(scanner, text):
    return {m.name for m in scanner.find(text)}


def endings(template, block):
    """The table of distances row by row: for each end the fewest differences and the earliest start."""
    above = [(0, j) for j in range(len(block) + 1)]
    for i, a in enumerate(template, 1):
        row = [(i, 0)]
        for j, b in enumerate(block, 1):
            (up, up_at), (left, left_at), (both, both_at) = above[j], row[-1], above[j - 1]
            row.append(min((up + 1, up_at), (left + 1, left_at), (both + (a != b), both_at)))
        above = row
    return above


def brute(text):
    """Each wording sought through the whole text, without candidate blocks, bits or savings: the longest match that holds
    others is found, and none after a negation."""
    words, found = licenses.wording(text), set()
    for name, texts in TEMPLATES.items():
        for t in map(lambda x: licenses.Template(name, x), texts):
            want = [w for w in t.words if licenses.fixed(w)]
            found |= {(start, end, name, d / len(t.words)) for end, (d, start) in enumerate(endings(t.words, words)) if d <= t.most and [w for w in words[start:end] if licenses.fixed(w)] == want}
    outer, begins = [], [w.start() for w in licenses._WORD.finditer(text)]
    for m in sorted(found, key=lambda m: (m[0], -m[1], m[3], m[2])):
        if not any(o[2] != m[2] and o[0] <= m[0] and m[1] <= o[1] for o in outer):
            outer.append(m)
    return {m[2] for m in outer if not licenses.negated(text, begins[m[0]])}


def test_distances_equal_the_plain_table():
    rng = random.Random(5)
    for _ in range(300):
        template, block = (rng.choices("abcd", k=rng.randint(1, n)) for n in (9, 40))
        forward = licenses.bits(template)
        assert list(licenses.distances(forward, len(template), block, False)) == [d for d, _ in endings(template, block)[1:]]
        plain = [len(template)]
        row = list(range(len(template) + 1))
        for b in block:
            row = next_row(row, template, b)
            plain.append(row[-1])
        assert list(licenses.distances(forward, len(template), block, True)) == plain[1:]


def next_row(row, template, b):
    out = [row[0] + 1]
    for i, a in enumerate(template, 1):
        out.append(min(out[-1] + 1, row[i] + 1, row[i - 1] + (a != b)))
    return out


def test_every_wording_is_found(scanner):
    for name, texts in TEMPLATES.items():
        for text in texts:
            assert names(scanner, text) == {name}, text
            wrapped = "\n".join(f" * {' '.join(text.split()[i : i + 7])}" for i in range(0, len(text.split()), 7))
            assert names(scanner, f"before\n{wrapped}\nafter words") == {name}, text


def test_equals_brute_force(scanner):
    rng = random.Random(3)
    every = [t for texts in TEMPLATES.values() for t in texts]
    for _ in range(60):
        words = []
        for text in rng.choices(every, k=3):
            own = text.split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                i = rng.randrange(len(own))
                own[i : i + rng.choice([0, 1])] = rng.choice([[], ["word"], ["not"], ["3"], ["the"]])
            words += own + ["filler"] * rng.choice([0, 0, 1, 5])
        text = " ".join(words)
        assert names(scanner, text) == brute(text), text


def test_versions_negations_and_names_are_exact(scanner):
    assert names(scanner, "Licensed under the GNU General Public License, version 2") == {"GPL-2.0"}
    assert names(scanner, "This work is not licensed under the GNU General Public License, version 3.") == set()
    assert names(scanner, "Never released under the MIT License.") == set()
    assert names(scanner, "This work is licensed under the GNU Lesser General Public License, version 3.") == {"LGPL-3.0"}
    assert names(scanner, "This work is licensed under the GNU General Public License, version 4.") == set()
    assert names(scanner, "Licensed under CC BY-NC-SA 4.0. All rights reserved.") == {"CC-BY-NC-SA-4.0", "all-rights-reserved"}
    later = TEMPLATES["GPL-3.0-or-later"][0]
    assert names(scanner, later) == {"GPL-3.0-or-later"} and "GPL-3.0-or-later" not in names(scanner, later.replace("version 3", "version 2"))
    header = TEMPLATES["Apache-2.0"][3]
    assert names(scanner, header.replace("may not use", "must not use")) == {"Apache-2.0"}
    assert sorted(m.differing for m in scanner.find(TEMPLATES["MIT"][3].replace("whom the Software", "whom the Product"))) == [0, 1]


def test_rows(spark):
    filler = "\n".join(f"word{i} other{i}" for i in range(20_000))
    rows = [
        (1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, "RELEASED!! UNDER!! THE!! MIT!! LICENCE."), (3, "Licensed under CC BY-NC 4.0."), (4, "The rights of others are not a license."),
        (5, "This | work | is | licensed | under | the | GNU | General | Public | License, | version | 3. | z"), (6, None), (7, ""), (8, "!!!"), (9, f"{filler}\n{TEMPLATES['MIT'][3]}\n{filler} Licensed under CC BY 4.0."),
        (None, "All rights reserved."), (3, "Licensed under CC BY-NC 4.0."), (10, "no license here\n" * 3000 + TEMPLATES["BSD"][0]), (11, "Released under the MIT License. Licensed under the MIT License."),
    ]
    frame = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, licenses string, n_licenses int")
    out = licenses.scan(frame)
    got = sorted(((r.doc_id, r.licenses) for r in out.collect()), key=repr)
    want = {1: ["Apache-2.0"], 2: ["MIT"], 3: ["CC-BY-NC-4.0"], 5: ["GPL-3.0"], 9: ["CC-BY-4.0", "MIT"], None: ["all-rights-reserved"], 10: ["BSD"], 11: ["MIT"]}
    assert got == sorted(((d, want.get(d, [])) for d, _ in rows), key=repr)
    assert all(r.saved > 0.3 and r.differing == 0 for r in out.where("n_licenses > 0 and doc_id <> 10").collect()) and out.where("n_licenses = 0 and (saved > 0 or differing is not null)").count() == 0
    assert licenses.scan(frame.limit(0)).count() == 0


def test_savings_choose_the_winners(scanner, monkeypatch):
    """Where nothing is saved nothing is found, and where all save alike what is found is wrong."""
    every = [(name, text) for name, texts in TEMPLATES.items() for text in texts]
    monkeypatch.setattr(scanner, "seen", {})
    monkeypatch.setattr(scanner, "reduction", lambda block, t: (100, 0))
    assert all(names(scanner, text) == set() for _, text in every)
    scanner.seen.clear()
    monkeypatch.setattr(scanner, "reduction", lambda block, t: (100, 50))
    assert any(names(scanner, text) != {name} for name, text in every)
    # The larger saving wins, whichever it is.
    text = TEMPLATES["GPL-3.0-or-later"][0]
    of = {t: x.name for t, x in enumerate(scanner.templates)}
    for winner in ("GPL-3.0-or-later", "nothing"):
        scanner.seen.clear()
        monkeypatch.setattr(scanner, "reduction", lambda block, t, winner=winner: (100, 50 if of[t] == winner else 0))
        assert names(scanner, text) == {winner} - {"nothing"}


@pytest.mark.parametrize("text, want", [
    ("This is not a work that is licensed under the GNU General Public License, version 3", set()), ("None of these files is licensed under the MIT License.", set()), ("It doesn't come\nlicensed under the MIT License.", set()),
    ("SPDX-License-Identifier: MIT", {"MIT"}), ("/* SPDX-License-Identifier: GPL-3.0-only */", {"GPL-3.0"}), ("SPDX-License-Identifier: GPL-2.0-or-later", {"GPL-2.0-or-later"}), ("SPDX-License-Identifier: Unknown-1.0", set()),
    ("Distributed under the terms of the MIT license.", {"MIT"}), ("licensed under a Creative Commons Attribution 4.0 International License", {"CC-BY-4.0"}), ("Available under the ISC licence", {"ISC"}),
    ("No warranty.\nLicensed under the MIT License.", {"MIT"}), ("There is no warranty, and it is licensed under the MIT License.", {"MIT"}), ("It is not ours.\n\nreleased under the MIT License", {"MIT"}), ("Without doubt: licensed under the MIT License.", {"MIT"}),
])
def test_tags_sentences_and_clauses(scanner, text, want):
    assert names(scanner, text) == want == brute(text)


def test_a_megabyte_of_notices():
    rng, out = random.Random(1), []
    for k in range(950):
        words = TEMPLATES["MIT"][3].split()
        words[[i for i, w in enumerate(words) if not licenses.fixed(w.strip(".,()\"").lower())][rng.randrange(60)]] = f"other{chr(97 + k % 26)}"
        out.append(" ".join(words))
    text, scanner = "\n".join(out), licenses.Scanner()
    assert len(text) > 900_000
    began = time.process_time()
    found = scanner.find(text)
    assert time.process_time() - began < 10
    whole = [m for m in found if m.end - m.start > 100]
    assert {m.name for m in found} == {"MIT"} and len(whole) == 950 and {m.differing for m in whole} <= {1, 2}
    assert all(a.end <= b.start for a, b in zip(whole, whole[1:], strict=False))
