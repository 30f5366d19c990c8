"""Licence notices, headings, identifiers and texts that license scans look for. All are public."""

from __future__ import annotations

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
    "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = (
    ", provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
    "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    "governing permissions and limitations under the License."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {version}. This program is distributed in the hope that it will be useful, but "
    "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
    "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
    "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
)

#: Names of SPDX that stand behind "SPDX-License-Identifier:".
IDENTIFIERS = (
    "Apache-2.0 Apache-1.1 MIT MIT-0 ISC BSD-2-Clause BSD-3-Clause 0BSD GPL-2.0-only GPL-2.0-or-later GPL-2.0 GPL-3.0-only GPL-3.0-or-later GPL-3.0 LGPL-2.1-only LGPL-2.1-or-later LGPL-2.1 LGPL-3.0-only LGPL-3.0-or-later LGPL-3.0 "
    "AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 MPL-2.0 EPL-1.0 EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 Unlicense Zlib BSL-1.0 WTFPL Artistic-2.0 CDDL-1.0 PostgreSQL Python-2.0"
).split()

#: template: (licence, text, phrases that must be in it)
NOTICES: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "Apache-2.0 notice": ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2.0",)),
    "Apache-2.0 header": ("Apache-2.0", _APACHE, ("apache license version 2.0", "except in compliance with the license")),
    "Apache-2.0 heading": ("Apache-2.0", "Apache License Version 2.0, January 2004", ("apache license version 2.0",)),
    "Apache-1.1 notice": ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1.", ("apache software license version 1.1",)),
    "MIT notice": ("MIT", "Released under the MIT License.", ("mit license",)),
    "MIT heading": ("MIT", "MIT License", ("mit license",)),
    "MIT grant": ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    "MIT text": ("MIT", f"{_MIT_GRANT} {_MIT_KEEP} {_MIT_AS_IS}", ("permission is hereby granted free of charge", "associated documentation files", "permission notice shall be included")),
    "ISC grant": ("ISC", _ISC, ("with or without fee is hereby granted",)),
    "ISC text": ("ISC", _ISC + _ISC_REST, ("with or without fee is hereby granted", "the author disclaims all warranties")),
    "ISC heading": ("ISC", "ISC License", ("isc license",)),
    "BSD grant": ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    "BSD-2-Clause text": ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    "BSD-3-Clause text": ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_AS_IS}", ("redistribution and use in source and binary forms", "endorse or promote products derived from this software")),
    "BSD-3-Clause notice": ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", ("bsd 3 clause",)),
    "BSD-2-Clause notice": ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", ("bsd 2 clause",)),
    "BSD-3-Clause heading": ("BSD-3-Clause", "BSD 3-Clause License", ("bsd 3 clause license",)),
    "BSD-2-Clause heading": ("BSD-2-Clause", "BSD 2-Clause License", ("bsd 2 clause license",)),
    "GPL-3.0 notice": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    "GPL-3.0 header": ("GPL-3.0", _GNU.format(name="General Public License", version="either version 3 of the License, or (at your option) any later version"), ("gnu general public license as published", "version 3 of the license")),
    "GPL-3.0 heading": ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ("gnu general public license version 3",)),
    "GPL-2.0 notice": ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    "GPL-2.0 header": ("GPL-2.0", _GNU.format(name="General Public License", version="either version 2 of the License, or (at your option) any later version"), ("gnu general public license as published", "version 2 of the license")),
    "GPL-2.0 heading": ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", ("gnu general public license version 2",)),
    "LGPL-3.0 notice": ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu lesser general public license version 3",)),
    "LGPL-3.0 header": ("LGPL-3.0", _GNU.format(name="Lesser General Public License", version="either version 3 of the License, or (at your option) any later version"), ("gnu lesser general public license as published", "version 3 of the license")),
    "LGPL-2.1 notice": ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1.", ("gnu lesser general public license version 2.1",)),
    "AGPL-3.0 notice": ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu affero general public license version 3",)),
    "AGPL-3.0 header": ("AGPL-3.0", _GNU.format(name="Affero General Public License", version="either version 3 of the License, or (at your option) any later version"), ("gnu affero general public license as published", "version 3 of the license")),
    "MPL-2.0 notice": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2.0",)),
    "MPL-2.0 header": ("MPL-2.0", _MPL, ("mozilla public license v 2.0", "if a copy of the mpl was not distributed")),
    "MPL-2.0 heading": ("MPL-2.0", "Mozilla Public License Version 2.0", ("mozilla public license version 2.0",)),
    "EPL-2.0 notice": ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2.0",)),
    "CC-BY-4.0 notice": ("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc by 4.0",)),
    "CC-BY-SA-4.0 notice": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4.0",)),
    "CC-BY-NC-4.0 notice": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4.0",)),
    "CC-BY-NC-SA-4.0 notice": ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", ("cc by nc sa 4.0",)),
    "CC-BY-ND-4.0 notice": ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", ("cc by nd 4.0",)),
    "CC0-1.0 notice": ("CC0-1.0", "Released under CC0 1.0 Universal.", ("cc0 1.0",)),
    "Unlicense notice": ("Unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software",)),
    "Unlicense text": ("Unlicense", _UNLICENSE, ("free and unencumbered software", "anyone is free to copy")),
    "Zlib text": ("Zlib", _ZLIB, ("alter it and redistribute it freely",)),
    "BSL-1.0 text": ("BSL-1.0", _BOOST, ("accompanying documentation covered by this license",)),
    "Proprietary notice": ("Proprietary", "All rights reserved.", ("all rights reserved",)),
} | {f"SPDX {k}": (k, f"SPDX-License-Identifier: {k}", (f"spdx license identifier {k}".lower(),)) for k in IDENTIFIERS}
