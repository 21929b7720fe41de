"""Wordings of licences by family, by paragraph. Public licence texts and notices."""

#: Whole short licences, and the notices and leading or closing paragraphs of long ones.
TEXTS = {
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES',
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS',
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "BSL-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software',
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. GNU General Public License Version 3, 29 June 2007",
        "You should have received a copy of the GNU General Public License along with this program. If not, see www.gnu.org/licenses",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA",
        "The licenses for most software are designed to take away your freedom to share and change it. GNU General Public License Version 2, June 1991",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0/.",
        'This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. 2.0.',
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at www.eclipse.org/legal/epl-2.0",
        'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.',
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ],
    "CC-BY": ["You are free to share and adapt the material for any purpose, even commercially. Attribution: You must give appropriate credit, provide a link to the license, and indicate if changes were made."],
    "CC-BY-SA": ["ShareAlike: If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "CC-BY-NC": ["NonCommercial: You may not use the material for commercial purposes."],
}

#: Names of each family's licences, and its identifiers.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "MIT/X11 License", "Expat License"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-clause BSD license", "New BSD License", "Simplified BSD License", "Modified BSD License"],
    "ISC": ["ISC License", "Internet Systems Consortium License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "Unlicense": ["Unlicense"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache Software License 2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPL version 3", "GPLv3", "GPL v3 license"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPL version 2", "GPLv2", "GPL v2 license"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "GNU LGPL version 2.1", "LGPL version 3", "LGPLv3", "LGPL v2.1 license"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPL version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License - v 2.0", "EPL 2.0"],
    "CC0": ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0"],
}
IDENTIFIERS = {
    "MIT": ["MIT"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "ISC": ["ISC"], "Zlib": ["Zlib"], "Unlicense": ["Unlicense"], "BSL-1.0": ["BSL-1.0"], "Apache-2.0": ["Apache-2.0"],
    "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"], "GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0"], "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "AGPL-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "MPL-2.0": ["MPL-2.0"], "EPL-2.0": ["EPL-2.0"], "CC0": ["CC0-1.0"], "CC-BY": ["CC-BY-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"],
}
#: Ways to name a licence; {} is its name.
PHRASES = [
    "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This project is licensed under the terms of the {}.", "Licensed under {}.",
    "Released under {}.", "This file is made available under the {}.", "The code is available under the {}; see the file LICENSE for details.", "License: {}", "published under the {}", "This software may be used under the {}.",
]
#: Sentences that speak of licences, rights or software without granting any.
OTHER = [
    "She was licensed to drive a car in three countries.", "His licence was revoked by the board of medicine last year.", "The licensing fee for the stadium rose again.", "A fishing license is required in this state.",
    "Permission to enter the building is granted by the guard at the door.", "You need a license to sell alcohol under the new law.", "The software is provided by the school to all pupils.", "This work is under review by the committee.",
    "MIT released the results of a study on Monday.", "The Apache helicopter was released under the new plan.", "The general public was asked to stay home.", "Copyright law was the subject of the lecture.",
    "The copies were distributed under the table.", "He works for the Mozilla foundation in Berlin.", "All rights of way are marked on the map.", "The eclipse was public and free for all to see.", "She gave credit to the author of the book.",
    "The license plate of the car was not readable.", "Creative people in common rooms share their work.", "The terms of the contract were published in 2007.",
]


def wordings() -> dict[str, list[tuple[str, str]]]:
    """(wording, kind) by family: a phrase, an identifier line or a paragraph of a text. Made by rule from the tables above."""
    out = {}
    for family, names in NAMES.items():
        found = [(p.format(n), p) for p in PHRASES for n in names]
        found += [(f"SPDX-License-Identifier: {x}", f"identifier {x}") for x in IDENTIFIERS[family]]
        out[family] = found + [(t, f"text {k}") for k, t in enumerate(TEXTS[family])]
    return out
