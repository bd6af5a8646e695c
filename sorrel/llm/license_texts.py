"""Passages of well-known licences: short notices, standard headers, and the sentences of the bodies that grant rights."""

from __future__ import annotations

_GNU_TAIL = (
    "This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)


def _gnu(label: str, name: str, version: str, thing: str) -> list[tuple[str, str, tuple[str, ...]]]:
    """Notice, header and full header of a licence of the GNU family; all must name the licence and its version."""
    keys = (f"gnu {name.lower()}", f"version {version.replace('.', ' ')}")
    head = (
        f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
        f"Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )
    return [
        (label, f"Licensed under the GNU {name}, version {version}", keys),
        (label, f"Licensed under the terms of the GNU {name}, version {version}", keys),
        (label, f"Distributed under the terms of the GNU {name} version {version} or later", keys),
        (label, head, keys),
        (label, f"{head} {_GNU_TAIL.format(thing=thing, name=name)}", keys),
    ]


def _cc(label: str, short: str, long: str) -> list[tuple[str, str, tuple[str, ...]]]:
    key = (f"cc {short} 4 0".lower().replace("-", " "),)
    full = (f"creative commons {long} 4 0 international".lower().replace("-", " "),)
    return [
        (label, f"Licensed under CC {short} 4.0", key),
        (label, f"This work is licensed under a Creative Commons {long} 4.0 International License.", full),
    ]


def _spdx(label: str, identifier: str) -> tuple[str, str, tuple[str, ...]]:
    words = identifier.lower().replace("-", " ").replace(".", " ")
    return label, f"SPDX-License-Identifier: {identifier}", (f"spdx license identifier {words}",)


#: Label, passage, key phrases that a match must hold.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    *_gnu("gpl-3.0", "General Public License", "3", "program"),
    *_gnu("gpl-2.0", "General Public License", "2", "program"),
    *_gnu("lgpl-3.0", "Lesser General Public License", "3", "library"),
    *_gnu("lgpl-2.1", "Lesser General Public License", "2.1", "library"),
    *_gnu("agpl-3.0", "Affero General Public License", "3", "program"),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", ("gnu general public license version 3",)),
    ("gpl-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.", ("gnu general public license", "copyleft license for software and other kinds of works")),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", ("gnu general public license version 2",)),
    ("gpl-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.", ("gnu general public license is intended to guarantee your freedom",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ("apache license version 2 0 january 2004",)),
    (
        "apache-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to "
        "reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        ("each contributor hereby grants to you a perpetual", "prepare derivative works of"),
    ),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "This project is licensed under the terms of the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("permission is hereby granted free of charge", "the above copyright notice and this permission notice shall be included"),
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    (
        "bsd-2-clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce"),
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("to endorse or promote products derived from this software",),
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("mozilla public license v 2 0",),
    ),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ("eclipse public license 2 0",)),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
        "a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software released into the public domain",),
    ),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ("permission is granted to anyone to use this software for any purpose",),
    ),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)", ("boost software license version 1 0",)),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    *_cc("cc-by-4.0", "BY", "Attribution"),
    *_cc("cc-by-sa-4.0", "BY-SA", "Attribution-ShareAlike"),
    *_cc("cc-by-nd-4.0", "BY-ND", "Attribution-NoDerivatives"),
    *_cc("cc-by-nc-4.0", "BY-NC", "Attribution-NonCommercial"),
    *_cc("cc-by-nc-sa-4.0", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    *_cc("cc-by-nc-nd-4.0", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    _spdx("mit", "MIT"),
    _spdx("apache-2.0", "Apache-2.0"),
    _spdx("gpl-2.0", "GPL-2.0"),
    _spdx("gpl-3.0", "GPL-3.0"),
    _spdx("lgpl-2.1", "LGPL-2.1"),
    _spdx("lgpl-3.0", "LGPL-3.0"),
    _spdx("agpl-3.0", "AGPL-3.0"),
    _spdx("bsd-2-clause", "BSD-2-Clause"),
    _spdx("bsd-3-clause", "BSD-3-Clause"),
    _spdx("mpl-2.0", "MPL-2.0"),
    _spdx("isc", "ISC"),
]
