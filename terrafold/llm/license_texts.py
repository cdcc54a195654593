"""Public license notices by SPDX identifier, each in several wordings. Fixed values."""

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_MIT_REST = """ (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_LEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_ONE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_THREE = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_APACHE_LEAD = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_APACHE_REST = """ You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_DISCLAIMED = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu(name: str, version: str, mark: str = ";") -> tuple[str, ...]:
    """The notice of a GNU license of a version or any later one, as programs, libraries and files have it."""
    body = f"is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{mark} either version {version} of the License, or (at your option) any later version."
    return (*(f"This {what} {body}" for what in ("program", "library", "file")), f"This work is licensed under the GNU {name}, version {version} or later.", f"Licensed under the GNU {name}, version {version} or later.")


def _plain(name: str, version: str) -> tuple[str, ...]:
    return (f"This work is licensed under the GNU {name}, version {version}.", f"Licensed under the GNU {name}, version {version}.", f"Licensed under the GNU {name} v{version}.")


def _commons(short: str, long: str) -> tuple[str, ...]:
    return (f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons {long} 4.0 International License.", f"This work is licensed under CC {short} 4.0.")


TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0.", _APACHE_LEAD, _APACHE_LEAD + _APACHE_REST),
    "GPL-2.0": _plain("General Public License", "2"),
    "GPL-2.0-or-later": _gnu("General Public License", "2"),
    "GPL-3.0": _plain("General Public License", "3"),
    "GPL-3.0-or-later": _gnu("General Public License", "3", ":"),
    "LGPL-2.1": _plain("Lesser General Public License", "2.1"),
    "LGPL-2.1-or-later": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0": _plain("Lesser General Public License", "3"),
    "LGPL-3.0-or-later": _gnu("Lesser General Public License", "3", ":"),
    "AGPL-3.0": _plain("Affero General Public License", "3"),
    "AGPL-3.0-or-later": _gnu("Affero General Public License", "3", ":"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License 2.0."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License 2.0."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", _MIT_GRANT, _MIT_GRANT + _MIT_REST),
    "BSD": (_BSD_LEAD, "Licensed under the BSD License."),
    "BSD-2-Clause": (f"{_BSD_LEAD}: {_BSD_ONE} {_BSD_TWO} {_BSD_END}", f"{_BSD_LEAD}: 1. {_BSD_ONE} 2. {_BSD_TWO} {_BSD_END}"),
    "BSD-3-Clause": (f"{_BSD_LEAD}: {_BSD_ONE} {_BSD_TWO} {_BSD_THREE}", f"{_BSD_LEAD}: 1. {_BSD_ONE} 2. {_BSD_TWO} 3. {_BSD_THREE}"),
    "ISC": (f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_DISCLAIMED}"),
    "0BSD": (f"{_ISC}. {_DISCLAIMED}",),
    "Zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "BSL-1.0": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "Distributed under the Boost Software License, Version 1.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0."),
    "CC-BY-4.0": _commons("BY", "Attribution"),
    "CC-BY-SA-4.0": _commons("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-ND-4.0": _commons("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-4.0": _commons("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-SA-4.0": _commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "all-rights-reserved": ("All rights reserved.",),
}

#: Identifiers that tags use for a license here, where they aren't its own name.
_TAGS = {"GPL-2.0-only": "GPL-2.0", "GPL-3.0-only": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0"}
#: Names of licenses in sentences.
_NAMED = {"MIT": "MIT License", "Apache-2.0": "Apache License, Version 2.0", "BSD": "BSD License", "ISC": "ISC License", "Zlib": "zlib License", "MPL-2.0": "Mozilla Public License 2.0", "EPL-2.0": "Eclipse Public License 2.0", "BSL-1.0": "Boost Software License 1.0"}
_SENTENCES = ("Distributed under the terms of the {0}", "Distributed under the {0}", "Released under the terms of the {0}", "Licensed under the terms of the {0}", "Available under the {0}", "Licensed under the {0}")


def _more(name: str) -> tuple[str, ...]:
    """Tags and sentences that name a license."""
    tags = [] if name == "all-rights-reserved" else [f"SPDX-License-Identifier: {i}" for i in (name, *(k for k, v in _TAGS.items() if v == name))]
    sentences = [s.format(_NAMED[name]) for s in _SENTENCES] if name in _NAMED else []
    own = [t.removeprefix("This work is ") for t in TEMPLATES[name] if t.startswith("This work is licensed under a Creative Commons")]
    return tuple(x for x in (*tags, *sentences, *own) if x not in TEMPLATES[name])


TEMPLATES = {name: (*texts, *_more(name)) for name, texts in TEMPLATES.items()}
