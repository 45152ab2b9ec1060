"""Licence texts and notices that documents are compared with: (label, telling words, text).

Fixed values, as published with the licences. The telling words are few of the
text's: a block without them close together is a like text about another licence.
"""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software."""

MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""

GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""

MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
software."""

AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You
should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

CC0 = """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or
neighboring rights to this work."""

EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
available at https://www.eclipse.org/legal/epl-2.0/"""

TEMPLATES = (
    ("mit", "free charge", MIT),
    ("mit", "other liability", MIT_DISCLAIMER),
    ("mit", "mit", "released under the MIT license"),
    ("apache", "apache", APACHE),
    ("apache", "apache", "licensed under the Apache license version 2.0"),
    ("gpl", "gnu general public", GPL),
    ("gpl", "gnu general public", "this work is licensed under the GNU general public license version 3"),
    ("lgpl", "gnu lesser", LGPL),
    ("agpl", "gnu affero", AGPL),
    ("agpl", "gnu affero", "this work is licensed under the GNU Affero general public license version 3"),
    ("bsd", "source binary forms", BSD),
    ("bsd", "bsd", "released under the BSD license"),
    ("isc", "with without fee", ISC),
    ("mpl", "mozilla", MPL),
    ("epl", "eclipse", EPL),
    ("artistic", "artistic", "licensed under the Artistic license version 2.0"),
    ("unlicense", "unencumbered", UNLICENSE),
    ("zlib", "misrepresented", ZLIB),
    ("cc0", "cc0", CC0),
    ("cc0", "cc0", "released under CC0 1.0 universal public domain dedication"),
    ("cc-by", "creative commons attribution", "this work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "cc by", "licensed under CC BY 4.0"),
    ("cc-by-nc", "cc by nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "cc by sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "cc by nd", "licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "cc by nc sa", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "cc by nc nd", "licensed under CC BY-NC-ND 4.0"),
)
