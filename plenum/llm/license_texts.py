"""Public license notices that the license scan looks for (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    """A notice.  must: words that have to be aligned, where only they tell it from notices of other licenses."""

    name: str
    text: str
    must: tuple[str, ...] = ()


MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
)

MIT = MIT_GRANT + (
    ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall "
    'be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE."
)

ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
    'this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
    "THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TERMS = (
    " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission."
)
BSD_DISCLAIMER = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

APACHE_GRANT = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
APACHE = APACHE_GRANT + (
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and '
    "limitations under the License."
)

GNU_GRANT = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version "
    "{version} of the License, or (at your option) any later version."
)
GNU_WARRANTY = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU {kind} for more details."
)
#: Name, kind and version; an empty version is a notice whose version is none of the others.
GNU = (
    ("GPL-2.0", "General Public License", "2"),
    ("GPL-3.0", "General Public License", "3"),
    ("GPL", "General Public License", ""),
    ("LGPL-2.1", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "Lesser General Public License", "3"),
    ("LGPL", "Lesser General Public License", ""),
    ("AGPL-3.0", "Affero General Public License", "3"),
)

MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
    "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
    "to the following restrictions"
)
CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."

#: Short and full form of a Creative Commons license's kind.
CREATIVE_COMMONS = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)

#: SPDX identifiers by the name that is reported.
SPDX = {
    "MIT": ("MIT",),
    "ISC": ("ISC",),
    "BSD-2-Clause": ("BSD-2-Clause",),
    "BSD-3-Clause": ("BSD-3-Clause",),
    "Apache-2.0": ("Apache-2.0",),
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"),
    "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "MPL-2.0": ("MPL-2.0",),
    "Unlicense": ("Unlicense",),
    "Zlib": ("Zlib",),
    "CC0-1.0": ("CC0-1.0",),
}

TEMPLATES = (
    Template("MIT", "Released under the MIT License.", ("mit",)),
    Template("MIT", "Licensed under the MIT License.", ("mit",)),
    Template("MIT", MIT_GRANT),
    Template("MIT", MIT),
    Template("ISC", ISC),
    Template("BSD", BSD_GRANT),
    Template("BSD-2-Clause", BSD_GRANT + BSD_TERMS + BSD_DISCLAIMER),
    Template("BSD-3-Clause", BSD_GRANT + BSD_TERMS + BSD_NAMES + BSD_DISCLAIMER),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    Template("Apache-2.0", APACHE_GRANT, ("apache",)),
    Template("Apache-2.0", APACHE),
    *(Template(name, "This work is licensed under the GNU {kind}, version {version}.".format(kind=kind, version=version), ("gnu", version)) for name, kind, version in GNU if version),
    *(Template(name, GNU_GRANT.format(kind=kind, version=version)) for name, kind, version in GNU),
    *(Template(name, (GNU_GRANT + GNU_WARRANTY).format(kind=kind, version=version)) for name, kind, version in GNU),
    Template("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0.", ("mozilla",)),
    Template("MPL-2.0", MPL),
    Template("Unlicense", UNLICENSE),
    Template("Zlib", ZLIB),
    Template("CC0-1.0", CC0),
    *(Template(f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0.", ("cc", kind.lower(), "4.0")) for kind, _ in CREATIVE_COMMONS),
    *(Template(f"CC-{kind}-4.0", f"This work is licensed under a Creative Commons {full} 4.0 International License.", (full.lower(), "4.0")) for kind, full in CREATIVE_COMMONS),
    Template("proprietary", "All rights reserved."),
    *(Template(name, f"SPDX-License-Identifier: {spdx}") for name, known in SPDX.items() for spdx in known),
)
