"""Templates of the license scan: names, short names and notices of common licences.

A template is ``(licence, text, required terms)``. A passage matches it only if it
holds all required terms, so that "License" alone is never close to "MIT License" and
no version stands in for another. Templates of sentences are made by a rule from the
names; those that deny a licence carry the licence ``""`` and give nothing.
"""

from __future__ import annotations

import re

# fixed values: SPDX identifiers with the public names and short names of the licences
LICENCES = [
    ("AGPL-3.0", ["GNU Affero General Public License version 3"], ["AGPL-3.0", "AGPLv3"]),
    ("Apache-1.1", ["Apache Software License, Version 1.1"], ["Apache-1.1"]),
    ("Apache-2.0", ["Apache License, Version 2.0"], ["Apache-2.0", "Apache 2.0"]),
    ("Artistic-2.0", ["Artistic License 2.0"], ["Artistic-2.0"]),
    ("BSD-2-Clause", ["BSD 2-Clause License"], ["BSD-2-Clause"]),
    ("BSD-3-Clause", ["BSD 3-Clause License"], ["BSD-3-Clause"]),
    ("BSL-1.0", ["Boost Software License, Version 1.0"], ["BSL-1.0"]),
    ("CC-BY-4.0", ["Creative Commons Attribution 4.0 International License"], ["CC BY 4.0"]),
    ("CC-BY-NC-4.0", ["Creative Commons Attribution-NonCommercial 4.0 International License"], ["CC BY-NC 4.0"]),
    ("CC-BY-NC-SA-4.0", ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
     ["CC BY-NC-SA 4.0"]),
    ("CC-BY-ND-4.0", ["Creative Commons Attribution-NoDerivatives 4.0 International License"], ["CC BY-ND 4.0"]),
    ("CC-BY-SA-3.0", ["Creative Commons Attribution-ShareAlike 3.0 Unported License"], ["CC BY-SA 3.0"]),
    ("CC-BY-SA-4.0", ["Creative Commons Attribution-ShareAlike 4.0 International License"], ["CC BY-SA 4.0"]),
    ("CC0-1.0", ["Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"], ["CC0 1.0", "CC0"]),
    ("EPL-2.0", ["Eclipse Public License version 2.0"], ["EPL-2.0"]),
    ("EUPL-1.2", ["European Union Public Licence version 1.2"], ["EUPL-1.2"]),
    ("GPL-2.0", ["GNU General Public License version 2", "GNU General Public License Version 2, June 1991"],
     ["GPL-2.0", "GPLv2"]),
    ("GPL-3.0", ["GNU General Public License version 3", "GNU General Public License Version 3, 29 June 2007"],
     ["GPL-3.0", "GPLv3"]),
    ("ISC", ["ISC License"], ["ISC"]),
    ("LGPL-2.1", ["GNU Lesser General Public License version 2.1"], ["LGPL-2.1", "LGPLv2.1"]),
    ("LGPL-3.0", ["GNU Lesser General Public License version 3"], ["LGPL-3.0", "LGPLv3"]),
    ("MIT", ["MIT License"], ["MIT"]),
    ("MPL-2.0", ["Mozilla Public License version 2.0"], ["MPL-2.0", "MPL 2.0"]),
    ("Unlicense", ["The Unlicense"], ["Unlicense"]),
    ("Zlib", ["zlib License"], ["Zlib"]),
]

_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as "
        "published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met")
_BSD_2 = (": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
          "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
          "conditions and the following disclaimer in the documentation and/or other materials provided with the "
          "distribution.")
_BSD_3 = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission.")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
            "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
            "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
            "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
            "DAMAGE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:")
_MIT_END = ("The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
            "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
            "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
            "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
            "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.")
_ISC_END = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
            "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
            "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
            "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")

# fixed values: public notices and texts with the terms that tell them from all others
NOTICES = [
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3), "affero foundation 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0", "apache license 2 compliance"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied. See the License for the specific language governing permissions and limitations under the "
                   "License. Apache License, Version 2.0", "apache license 2 governing limitations"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "apache 2 january 2004"),
    ("BSD-2-Clause", _BSD + _BSD_2 + " " + _BSD_END, "redistribution redistributions retain reproduce merchantability"),
    ("BSD-3-Clause", _BSD, "redistribution binary forms modification permitted"),
    ("BSD-3-Clause", _BSD_3, "neither contributors endorse promote"),
    ("BSD-3-Clause", _BSD + _BSD_2 + " 3. " + _BSD_3 + " " + _BSD_END,
     "redistribution redistributions retain reproduce endorse merchantability"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy "
                "at http://www.boost.org/LICENSE_1_0.txt)", "boost license 1"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work.", "waived copyright neighboring rights"),
    ("GPL-2.0", _GNU.format("General Public License", 2), "gnu general foundation 2"),
    ("GPL-2.0", "the Free Software Foundation; either version 2 of the License, or", "free foundation 2 license"),
    ("GPL-3.0", _GNU.format("General Public License", 3), "gnu general foundation 3"),
    ("GPL-3.0", "the Free Software Foundation, either version 3 of the License, or", "free foundation 3 license"),
    ("ISC", _ISC, "permission fee granted appear"),
    ("ISC", "ISC License " + _ISC + " " + _ISC_END, "permission fee granted appear tortious"),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1"), "lesser foundation 2 1"),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3), "lesser foundation 3"),
    ("MIT", _MIT, "permission granted charge deal restriction"),
    ("MIT", "MIT License " + _MIT + " " + _MIT_END, "permission granted charge deal restriction noninfringement"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mozilla 2"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
             "held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
             "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
             "subject to the following restrictions:", "permission granted alter redistribute freely"),
]

NAMED = ["{}", "Licensed under the {}", "This work is licensed under the {}", "Released under the {}",
         "This software is distributed under the terms of the {}"]
SHORT = ["Licensed under {}", "License: {}", "Released under the {} license"]
DENIED = ["Not licensed under the {}", "This is not licensed under the {}", "This software is not released under the {}"]
# words of a sentence that a passage may lack; "0" so that version 2 is also 2.0
WEAK = frozenset("the a of and under is this work to in version v 0 international unported universal released software "
                 "distributed terms 29 june 1991 2007".split())


def words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def make_templates(licences=None, notices=None) -> list[tuple[str, str, tuple[str, ...]]]:
    """Sorted ``(licence, text, required terms)``; a licence of ``""`` gives nothing."""
    out = {}
    for name, text, keys in NOTICES if notices is None else notices:
        out[name, text] = tuple(sorted(words(keys)))
    for spdx, names, short in LICENCES if licences is None else licences:
        texts = [(spdx, f.format(n)) for n in names for f in NAMED] + [(spdx, f.format(n)) for n in short for f in SHORT]
        texts += [(spdx, "SPDX-License-Identifier: " + spdx + end) for end in ("", "-only", "-or-later")]
        texts += [("", f.format(n)) for n in [*names, *short] for f in DENIED]
        # a denial may leave the version out: "not licensed under the Apache License"
        bare = [re.sub(r"(,? version)? [0-9.]+.*$", "", n, flags=re.I) for n in names]
        texts += [("", f.format(b)) for b in bare for f in DENIED]
        for name, text in texts:
            out[name, text] = tuple(sorted(set(words(text)) - WEAK))
    return [(n, t, k) for (n, t), k in sorted(out.items())]


TEMPLATES = make_templates()
