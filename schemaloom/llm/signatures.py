"""Signatures of licenses, one a line: label | priority | regex over words.

Words are lower-case runs of letters, digits and characters beyond ASCII, one space between ("2.0" is
two words). `~` marks the keyword that a text must hold before the regex is tried, `<2.0>` is a version
with or without "version" or "v" before it, `LIC` is either spelling of licence. Priorities: 6 passages
of a license's own text, 5 notices that grant it, 4 full names with a version, 3 full names, 2 short
names, 1 hints. Names in SPDX come from the list of identifiers below, at priority 5.
"""

SIGNATURES = r"""
mit | 6 | permission is hereby granted ~free of charge to any person obtaining a copy of this software and associated documentation files
mit | 6 | the above ~copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 6 | in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract ~tort or otherwise
mit-0 | 6 | permission is hereby ~granted free of charge to any person obtaining a copy of this software and associated documentation files (?:the software )?to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit | 5 | (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?~mit LIC
mit | 5 | (?:subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?~mit LIC
mit | 3 | the ~mit LIC
mit | 2 | ~mit LIC
mit | 2 | ~mit x11 LIC
mit | 2 | ~expat LIC
x11 | 2 | ~x11 LIC
mit | 1 | ~mit (?:style|like|type) LIC
mit-0 | 3 | mit no ~attribution LIC
bsd | 6 | ~redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 6 | ~redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 6 | ~redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | 6 | ~neither the name of .{1,80} nor the names of (?:its|any|the) contributors may be used to endorse or promote products derived from this software
bsd-4-clause | 6 | all ~advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-2-clause | 3 | ~bsd 2 clause(?: simplified)?(?: LIC)?
bsd-2-clause | 3 | (?:the )?(?:2|two) clause ~bsd LIC
bsd-2-clause | 3 | (?:the )?(?:simplified|freebsd) ~bsd LIC
bsd-2-clause | 3 | the ~freebsd LIC
bsd-3-clause | 3 | ~bsd 3 clause(?: new or revised)?(?: LIC)?
bsd-3-clause | 3 | (?:the )?(?:3|three) clause ~bsd LIC
bsd-3-clause | 3 | (?:the )?(?:new|revised|modified) ~bsd LIC
bsd-4-clause | 3 | ~bsd 4 clause(?: LIC)?
bsd-4-clause | 3 | (?:the )?(?:4|four|original|old) (?:clause )?~bsd LIC
0bsd | 3 | (?:zero clause ~bsd|bsd zero clause|0 clause bsd)(?: LIC)?
bsd | 5 | (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the |a )?~bsd (?:style )?LIC
bsd | 2 | ~bsd LIC
bsd | 1 | ~bsd (?:style|like|type) LIC
bsd | 1 | ~berkeley software distribution
isc | 6 | permission to use copy modify and or distribute this software for any purpose with or without fee is ~hereby granted
isc | 5 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?~isc LIC
isc | 2 | ~isc LIC
isc | 3 | internet systems ~consortium LIC
apache-2.0 | 6 | ~licensed under the apache LIC <2.0> the LIC you may not use this file except in compliance with the LIC
apache-2.0 | 6 | you may obtain a copy of the LIC at http www ~apache org licenses LIC 2 0
apache-2.0 | 6 | unless required by applicable law or agreed to in writing software distributed under the LIC is distributed on an as is basis without ~warranties or conditions of any kind
apache-2.0 | 6 | subject to the terms and conditions of this LIC each ~contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) LIC
apache-2.0 | 4 | ~apache (?:software )?LIC <2.0>
apache-2.0 | 4 | ~apache (?:software )?LIC <2>
apache-1.1 | 4 | ~apache (?:software )?LIC <1.1>
apache-1.0 | 4 | ~apache (?:software )?LIC <1.0>
apache | 5 | (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?~apache (?:software )?LIC
apache | 2 | ~apache (?:software )?LIC
apache-2.0 | 2 | ~asl <2.0>
gpl | 6 | this program is ~free software you can redistribute it and or modify it under the terms of the gnu general public LIC
gpl | 6 | this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of ~merchantability or fitness for a particular purpose
gpl | 6 | you should have ~received a copy of the gnu general public LIC along with this program
gpl | 6 | the licenses for most software are designed to take away your ~freedom to share and change it
gpl-1.0 | 4 | gnu ~general public LIC <1>
gpl-2.0 | 4 | gnu ~general public LIC <2>
gpl-3.0 | 4 | gnu ~general public LIC <3>
gpl-2.0-or-later | 5 | gnu ~general public LIC (?:as published by the free software foundation )?(?:either )?<2> (?:of the LIC )?or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0-or-later | 5 | gnu ~general public LIC (?:as published by the free software foundation )?(?:either )?<3> (?:of the LIC )?or (?:at your option )?(?:any )?later(?: version)?
gpl-2.0 | 3 | (?:gnu )?~gpl <2>
gpl-3.0 | 3 | (?:gnu )?~gpl <3>
gpl-2.0 | 3 | (?:gnu )?~gplv2
gpl-3.0 | 3 | (?:gnu )?~gplv3
gpl-2.0-or-later | 4 | (?:gnu )?~gpl <2> or (?:any )?later(?: version)?
gpl-3.0-or-later | 4 | (?:gnu )?~gpl <3> or (?:any )?later(?: version)?
gpl | 5 | (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?~gnu general public LIC
gpl | 5 | (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?~gpl
gpl | 3 | gnu ~general public LIC
gpl | 2 | general ~public LIC
gpl | 2 | (?:gnu )?~gpl LIC
gpl | 1 | ~gpl compatible
gpl-classpath | 4 | gnu ~classpath exception
gpl-classpath | 4 | ~gpl (?:<2> )?with (?:the )?classpath exception
gpl-linking | 4 | gcc ~runtime library exception
lgpl | 6 | this library is ~free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public LIC
lgpl | 6 | you should have received a copy of the gnu ~lesser general public LIC along with this (?:library|program)
lgpl-2.0 | 4 | gnu ~library general public LIC <2>
lgpl-2.1 | 4 | gnu ~lesser general public LIC <2.1>
lgpl-3.0 | 4 | gnu ~lesser general public LIC <3>
lgpl-2.1 | 3 | (?:gnu )?~lgpl <2.1>
lgpl-3.0 | 3 | (?:gnu )?~lgpl <3>
lgpl-2.1 | 3 | ~lgplv2 1
lgpl-3.0 | 3 | ~lgplv3
lgpl-2.1-or-later | 4 | (?:gnu )?~lgpl <2.1> or (?:any )?later(?: version)?
lgpl | 5 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?~lgpl
lgpl | 3 | gnu ~lesser general public LIC
lgpl | 3 | gnu ~library general public LIC
lgpl | 2 | ~lesser general public LIC
lgpl | 2 | (?:gnu )?~lgpl
agpl | 6 | ~redistribute it and or modify it under the terms of the gnu affero general public LIC
agpl | 6 | notwithstanding any other provision of this LIC if you modify the program your modified version must prominently offer all users ~interacting with it remotely
agpl-3.0 | 4 | gnu ~affero general public LIC <3>
agpl-1.0 | 4 | ~affero general public LIC <1>
agpl-3.0 | 3 | (?:gnu )?~agpl <3>
agpl-3.0 | 3 | ~agplv3
agpl | 5 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?~agpl
agpl | 3 | (?:gnu )?~affero general public LIC
agpl | 2 | (?:gnu )?~agpl
gfdl | 6 | permission is granted to copy distribute and or modify this document under the terms of the gnu free ~documentation LIC
gfdl-1.1 | 4 | gnu free ~documentation LIC <1.1>
gfdl-1.2 | 4 | gnu free ~documentation LIC <1.2>
gfdl-1.3 | 4 | gnu free ~documentation LIC <1.3>
gfdl | 3 | gnu free ~documentation LIC
gfdl | 2 | (?:gnu )?~gfdl
mpl | 6 | this source code form is subject to the terms of the ~mozilla public LIC
mpl | 6 | if a copy of the mpl was not distributed with this file you can obtain one at (?:http|https) ~mozilla org mpl 2 0
mpl-1.0 | 4 | ~mozilla public LIC <1.0>
mpl-1.1 | 4 | ~mozilla public LIC <1.1>
mpl-2.0 | 4 | ~mozilla public LIC <2>
mpl-1.1 | 3 | ~mpl <1.1>
mpl-2.0 | 3 | ~mpl <2>
mpl | 5 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?~mozilla public LIC
mpl | 3 | ~mozilla public LIC
mpl | 2 | ~mpl LIC
npl | 3 | ~netscape public LIC
epl | 6 | this program and the accompanying materials are made available under the terms of the ~eclipse public LIC
epl-1.0 | 4 | ~eclipse public LIC <1>
epl-2.0 | 4 | ~eclipse public LIC <2>
epl-1.0 | 3 | ~epl <1>
epl-2.0 | 3 | ~epl <2>
epl | 3 | ~eclipse public LIC
edl | 3 | eclipse ~distribution LIC
cpl-1.0 | 3 | ~common public LIC
ibmpl | 3 | ~ibm public LIC
eupl-1.1 | 4 | european ~union public LIC <1.1>
eupl-1.2 | 4 | european ~union public LIC <1.2>
eupl | 3 | european ~union public LIC
eupl | 2 | ~eupl
cddl | 6 | the contents of this file are subject to the terms of the common ~development and distribution LIC
cddl-1.0 | 4 | common ~development and distribution LIC <1.0>
cddl-1.1 | 4 | common ~development and distribution LIC <1.1>
cddl | 3 | common ~development and distribution LIC
cddl | 2 | ~cddl
artistic-1.0 | 4 | ~artistic LIC <1>
artistic-2.0 | 4 | ~artistic LIC <2>
artistic | 5 | under the same terms as ~perl (?:5 )?itself
artistic | 3 | the ~artistic LIC
artistic | 2 | ~artistic LIC
zlib | 6 | this software is provided as is without any express or implied warranty in no event will the authors be held ~liable for any damages arising from the use of this software
zlib | 6 | the ~origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 6 | ~altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 2 | (?:the )?~zlib (?:libpng )?LIC
libpng | 2 | (?:the )?~libpng LIC
boost | 6 | permission is hereby granted free of charge to any person or ~organization obtaining a copy of the software and accompanying documentation covered by this LIC
boost-1.0 | 4 | ~boost software LIC <1.0>
boost | 3 | ~boost(?: software)? LIC
unlicense | 6 | this is free and ~unencumbered software released into the public domain
unlicense | 3 | the ~unlicense
unlicense | 2 | ~unlicense
wtfpl | 6 | everyone is permitted to copy and distribute ~verbatim or modified copies of this LIC document and changing it is allowed as long as the name is changed
wtfpl | 3 | do what the f(?:uck)? you want to ~public LIC
wtfpl | 2 | ~wtfpl
ofl | 6 | this font software is ~licensed under the sil open font LIC
ofl-1.1 | 4 | ~sil open font LIC <1.1>
ofl-1.0 | 4 | ~sil open font LIC <1.0>
ofl | 3 | (?:sil )?open ~font LIC
cc0 | 6 | to the extent possible under law .{1,80} has ~waived all copyright and related or neighboring rights
cc0-1.0 | 4 | ~cc0 <1.0>(?: universal)?
cc0 | 3 | creative ~commons zero
cc0 | 2 | ~cc0
cc-by-4.0 | 4 | ~cc by <4.0>
cc-by-3.0 | 4 | ~cc by <3.0>
cc-by-2.5 | 4 | ~cc by <2.5>
cc-by-2.0 | 4 | ~cc by <2.0>
cc-by-sa-4.0 | 4 | ~cc by sa <4.0>
cc-by-sa-3.0 | 4 | ~cc by sa <3.0>
cc-by-sa-2.5 | 4 | ~cc by sa <2.5>
cc-by-nc-4.0 | 4 | ~cc by nc <4.0>
cc-by-nc-3.0 | 4 | ~cc by nc <3.0>
cc-by-nd-4.0 | 4 | ~cc by nd <4.0>
cc-by-nd-3.0 | 4 | ~cc by nd <3.0>
cc-by-nc-sa-4.0 | 4 | ~cc by nc sa <4.0>
cc-by-nc-sa-3.0 | 4 | ~cc by nc sa <3.0>
cc-by-nc-nd-4.0 | 4 | ~cc by nc nd <4.0>
cc-by-nc-nd-3.0 | 4 | ~cc by nc nd <3.0>
cc-by-sa | 3 | ~cc by sa
cc-by-nc | 3 | ~cc by nc
cc-by-nd | 3 | ~cc by nd
cc-by-nc-sa | 3 | ~cc by nc sa
cc-by-nc-nd | 3 | ~cc by nc nd
cc-by | 2 | ~cc by
cc-by-4.0 | 4 | creative commons ~attribution <4.0>
cc-by-3.0 | 4 | creative commons ~attribution <3.0>
cc-by-sa-4.0 | 4 | creative commons ~attribution share ?alike <4.0>
cc-by-sa-3.0 | 4 | creative commons ~attribution share ?alike <3.0>
cc-by-nc-sa | 4 | creative commons ~attribution non ?commercial share ?alike
cc-by-nc-nd | 4 | creative commons ~attribution non ?commercial no ?deriv(?:s|atives|ative works)
cc-by-nc | 4 | creative commons ~attribution non ?commercial
cc-by-nd | 4 | creative commons ~attribution no ?deriv(?:s|atives|ative works)
cc-by-sa | 4 | creative commons ~attribution share ?alike
cc-by | 3 | creative commons ~attribution
cc-by | 5 | (?:http|https) ~creativecommons org licenses by [0-9] [0-9]
cc-by-sa | 5 | (?:http|https) ~creativecommons org licenses by sa [0-9] [0-9]
cc-by-nc | 5 | (?:http|https) ~creativecommons org licenses by nc [0-9] [0-9]
cc-by-nd | 5 | (?:http|https) ~creativecommons org licenses by nd [0-9] [0-9]
cc-by-nc-sa | 5 | (?:http|https) ~creativecommons org licenses by nc sa [0-9] [0-9]
cc-by-nc-nd | 5 | (?:http|https) ~creativecommons org licenses by nc nd [0-9] [0-9]
cc0 | 5 | (?:http|https) ~creativecommons org publicdomain zero 1 0
cc | 1 | (?:a )?creative ~commons LIC
odbl | 4 | open (?:data commons open )?~database LIC <1.0>
odbl | 3 | open (?:data commons open )?~database LIC
odbl | 2 | ~odbl
odc-by | 3 | open data commons ~attribution LIC
pddl | 3 | public domain ~dedication and LIC
python | 6 | psf is making python available to licensee on an as is ~basis
python-2.0 | 4 | ~python software foundation LIC <2>
python | 3 | ~python (?:software foundation )?LIC
ruby | 2 | the ~ruby LIC
php | 4 | the ~php LIC <3.01>
php | 2 | the ~php LIC
openssl | 6 | this product includes software developed by the ~openssl project for use in the openssl toolkit
openssl | 2 | ~openssl LIC
postgresql | 2 | ~postgresql LIC
ncsa | 3 | university of ~illinois ncsa open source LIC
ncsa | 2 | ~ncsa LIC
afl-3.0 | 3 | academic ~free LIC(?: <3.0>)?
osl-3.0 | 3 | open ~software LIC(?: <3.0>)?
ms-pl | 3 | ~microsoft public LIC
ms-rl | 3 | ~microsoft reciprocal LIC
qpl | 3 | q ~public LIC
sleepycat | 2 | ~sleepycat LIC
vim | 2 | ~vim LIC
w3c | 3 | ~w3c software (?:notice and )?LIC
upl-1.0 | 3 | ~universal permissive LIC
beerware | 6 | if we meet some day and you think this stuff is worth it you can buy me a ~beer in return
beerware | 2 | ~beerware(?: LIC)?
bluesky | 3 | blue ~oak model LIC
mulan | 3 | ~mulan (?:psl|permissive software LIC)
elastic-2.0 | 3 | ~elastic LIC <2>
sspl-1.0 | 3 | server ~side public LIC
bsl-1.1 | 3 | ~business source LIC
commons-clause | 3 | ~commons clause
polyform | 3 | ~polyform (?:noncommercial|shield|perimeter|strict|small business) LIC
rail | 3 | (?:creativeml )?open ~rail m(?: LIC)?
rail | 3 | (?:creativeml )?~openrail(?: m)?(?: LIC)?
rail | 2 | responsible ~ai LIC
llama | 3 | ~llama (?:[0-9](?: [0-9])? )?community LIC
ogl-3.0 | 4 | open ~government LIC <3>
ogl | 3 | open ~government LIC
etalab | 2 | ~etalab(?: open)? LIC
public-domain | 5 | (?:released|placed|dedicated) (?:in|into|to) the public ~domain
public-domain | 2 | public ~domain
proprietary | 6 | unauthorized copying of this file via any medium is strictly ~prohibited
proprietary | 5 | no part of this (?:publication|work|document|book) may be ~reproduced
proprietary | 5 | this (?:software|document|file) is (?:the )?~proprietary (?:information|property) of
proprietary | 3 | ~confidential and proprietary
proprietary | 3 | ~proprietary and confidential
proprietary | 2 | ~proprietary (?:LIC|software)
proprietary | 2 | all rights ~reserved
proprietary | 2 | end user LIC ~agreement
notice | 1 | ~licensed under (?:the )?(?:terms of )?the LIC
notice | 1 | see the ~license file
notice | 1 | see ~copying for details
"""

#: SPDX identifiers as written in `SPDX-License-Identifier:` lines.
IDENTIFIERS = """
0BSD AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0
BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1
CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC0-1.0
CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 Elastic-2.0
GFDL-1.2-only GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later
ISC LGPL-2.0-only LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c
MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NPL-1.1 ODbL-1.0 OFL-1.0 OFL-1.1 OSL-3.0 OpenSSL
PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 Sleepycat UPL-1.0 Unicode-DFS-2016 Unlicense Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()
