"""The notices of common licences as their publishers print them.

Each is (label, text, key phrases). The first key phrase is the anchor, by which a notice is looked
up; all of them must stand in a file, at their places in the text, for the notice to be found.
"""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_CLAUSE_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""

_GPL_2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""

_GPL_3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""

_LGPL = """under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1
of the License, or (at your option) any later version."""

_AGPL = """under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3
of the License, or (at your option) any later version."""

_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin
of this software must not be misrepresented; you must not claim that you wrote the original software."""

_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software"""

NOTICES = [
    ("apache-2.0", _APACHE, ["licensed under the apache license version 2 0"]),
    ("gpl-2.0-header", _GPL_2, ["under the terms of the gnu general public license as published by the free software foundation either version 2"]),
    ("gpl-3.0-header", _GPL_3, ["under the terms of the gnu general public license as published by the free software foundation either version 3"]),
    ("gpl-2.0", "under the terms of the GNU General Public License version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("lgpl", _LGPL, ["gnu lesser general public license"]),
    ("agpl", _AGPL, ["gnu affero general public license"]),
    ("mit-notice", "Released under the MIT License", ["released under the mit license"]),
    ("mit-text", _MIT_GRANT, ["permission is hereby granted free of charge to any person obtaining a copy of this software", "without warranty of any kind"]),
    ("mit-grant", _MIT_GRANT, ["permission is hereby granted free of charge to any person obtaining a copy of this software"]),
    ("bsd-2-clause", _BSD_START, ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice"]),
    ("bsd-3-clause", f"{_BSD_START} {_BSD_CLAUSE_3}", ["redistribution and use in source and binary forms", "products derived from this software without specific prior written permission"]),
    ("bsd", _BSD_START, ["redistribution and use in source and binary forms"]),
    ("isc", _ISC, ["permission to use copy modify and or distribute this software for any purpose"]),
    ("mpl-2.0", _MPL, ["mozilla public license v 2 0"]),
    ("unlicense", _UNLICENSE, ["free and unencumbered software released into the public domain"]),
    ("zlib", _ZLIB, ["the origin of this software must not be misrepresented"]),
    ("bsl-1.0", _BOOST, ["any person or organization obtaining a copy of the software and accompanying documentation"]),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0", ["cc0 1 0"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ["cc by nc sa 4 0"]),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ["cc by nd 4 0"]),
]

# Words too common to be looked up.
COMMON = "the of and to in is a this that for with by any are it or as on use under an at be was you from 0 1 2 3 4 v".split()
