"""Known licence texts and notices by SPDX identifier (fixed values: the public wording of the licences)."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""

_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS
IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""

#: Entire texts and one-line notices of each licence.
LICENCES: dict[str, list[str]] = {
    "MIT": [
        _MIT_GRANT,
        "MIT License\n\n" + _MIT_GRANT,
        "The MIT License\n\n" + _MIT_GRANT,
        "The MIT License (MIT)\n\n" + _MIT_GRANT,
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [_ISC_GRANT + "\n\n" + _ISC_WARRANTY, "ISC License\n\n" + _ISC_GRANT + "\n\n" + _ISC_WARRANTY, "SPDX-License-Identifier: ISC"],
    "BSD-2-Clause": [
        _BSD_HEAD + "\n\n" + _BSD_WARRANTY,
        "BSD 2-Clause License\n\n" + _BSD_HEAD + "\n\n" + _BSD_WARRANTY,
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        _BSD_HEAD + "\n\n" + _BSD_NAME + "\n\n" + _BSD_WARRANTY,
        "BSD 3-Clause License\n\n" + _BSD_HEAD + "\n\n" + _BSD_NAME + "\n\n" + _BSD_WARRANTY,
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "Unlicense": [_UNLICENSE, "SPDX-License-Identifier: Unlicense"],
    "Zlib": [_ZLIB, "zlib License\n\n" + _ZLIB, "SPDX-License-Identifier: Zlib"],
    "Apache-2.0": [
        _APACHE_NOTICE,
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under CC BY-NC-SA 4.0."],
    "All-Rights-Reserved": ["All rights reserved."],
}

#: Canonical digests of entire texts that are too long to keep here: as published, for some also without the appendix on
#: how to apply them, with and without the line that ends the terms.
FULL_TEXTS: dict[str, list[str]] = {
    "Apache-2.0": [
        "56a2d5e3fe444e9fb257dac62aea9e09aebc1d7f4a24ba1e14abd1c1313d3bbd",
        "37b782c7f6e018adba9988ea8f029f64adebe8f799338abfce90a282808ae88b",
        "2b8291b0741176e414652100fde6d1e48448a5aec5b35508c1646029842ac71a",
    ],
    "CC-BY-SA-4.0": ["4dd2d8faa991a43111f73718974d1a9133ba1453cd76d174da75d163e35fa974"],
    "CC0-1.0": ["96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"],
    "GFDL-1.2": ["277b073f560ccc9bb23c717a28b4b62dfe603cbd5736d74124fbf6df226962e1"],
    "GFDL-1.3": ["f056a741e538cc8d4ee261da17bcc661eb7101dbdc801b47e5bc3f8d87911d92"],
    "GPL-1.0": [
        "489aece6b651f8d0d05ab5dcaae302405ffe67295a16370915785227ae58b8a0",
        "222c05657115ed34d61f120a8419b4b1e816d6a366767bce5e8fff929952f99c",
        "91ef993d2bf9089671239b975ab8cbf63fbce388f70b619e963f52db0c67ea61",
    ],
    "GPL-2.0": [
        "209448d2ac992121b55bfa8392e347d2fab6446cb3366c268b386a091c98edc1",
        "a20b59ce4ee1ec50720e498595f3e36e1cc255241777de80d68514d9a0d87088",
        "0b53adedb67fca6aaf9d629ad1f0b4d2e7acbdee2314415502a1f8c02db659b1",
    ],
    "GPL-3.0": [
        "af9f91d975e5d0cd3073aca8e75d1d95b51c56842cd3a7d986f3c28acab1d5b3",
        "c8e266211c0003b5c5dadb60251c52724efe900915da2e4e96bb1264f5ef17c5",
        "300d2fcccb3dc85da82e6669d13906473c2678e54a62dd0e95ffd8aafee98971",
    ],
    "LGPL-2.0": [
        "1e092581422e9ad28d43b6c033feb0627df4128ae556534cfac1d24eed326934",
        "8f5851969abe251b8e39d07f48d1640a25324cd6764e5ca89cd55df2a19d8a19",
        "e075523bf74370289721a7c17d24f9789f2dcda0a5e7f88053b8ccb40697c42e",
    ],
    "LGPL-2.1": [
        "0edd6a78a4d4880e7fd819d584a571538e26d3b1dcf075757a5f9bb54ff7c119",
        "73940745ff5c9a7abcf8353075426f9d9949f83ca8131ef660f37b227ac57972",
        "fe267ee176ec23ee436aef3942be507a2aa4dacae6808c8fdc46190f98d0d4f2",
    ],
    "LGPL-3.0": ["fc640711c26bbae68fd0bc0a61589a05ad09077db315c5395f64fd207d1810ff"],
    "MPL-1.1": ["1ca1eb8cbfd7655f7701470d19ccbf04a694870df7b9fce8510a06df743e439a"],
    "MPL-2.0": ["09e5ba69869316871f9d2747c47173b083d2ee54d621b8700ef01440231824f8"],
}
