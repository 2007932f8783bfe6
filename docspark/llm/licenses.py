"""License scans by ordered signature rules, in DataFrame functions only.

A text is normalised to its words, parted by single spaces. A rule has a keyword, a regular expression over the words, a
priority and a label. Texts without any of a few gate words are done at once; of the others, the rules whose keyword
occurs are matched at all places. A detection that lies inside one of a rule of higher rank (priority, then order) is
suppressed; detections are folded in order of their start, with the few that still reach over the present one.
"""

from __future__ import annotations

import functools
import json
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import fresh
from docspark.llm.quality import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before lower-casing.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Phrases of the contract and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Any of these sets of strings, all found in the lower-cased text, opens the gate.
STEMS = [
    ["licen"], ["cc", "by"], ["spdx"], ["rights", "reserved"], ["public", "domain"], ["copyleft"], ["wtfpl"], ["gpl"], ["creative", "commons"], ["apache"], ["copyright"],
    ["hereby", "granted"], ["redistribution", "binary"], ["permission", "fee"], ["redistribute", "modify"], ["proprietary"], ["bsd"], ["cc0"], ["mit", "attribution"],
    ["redistribution", "retain"], ["redistribution", "reproduce"], ["endorse", "promote"], ["warrant"], ["event", "liab"], ["misrepresent", "origin"], ["altered", "source"], ["perpetual", "worldwide"], ["free software", "foundation"], ["covered", "form"],
    ["substantial", "portions"], ["larger", "work"], ["corresponding", "source"], ["remote", "network"], ["share", "alike"], ["noncommercial"], ["non", "commercial", "use"], ["trade", "secret"], ["unauthori", "copying"], ["confidential"], ["reproduc", "permission"],
    ["personal", "evaluation"], ["source", "available"], ["advertising", "acknowledg"], ["sublicens"], ["waive"], ["font", "reserved", "name"], ["do what", "want"],
]

_V = r"(?: version| v)?"
#: label, keyword, the name as words, and its short identifier as words (None: a further
#: name of a license above). Whatever the name matches contains the keyword. Of names that start alike, the longer comes first.
NAMES = [
    ("mit", "mit", r"(?:mit|x11 mit) license", r"mit"),
    ("mit", "expat", r"expat license", None),
    ("mit-0", "mit", r"mit no attribution(?: license)?", r"mit 0"),
    ("x11", "x11", r"x11 license", r"x11"),
    ("isc", "isc", r"isc license", r"isc"),
    ("apache-2", "apache", rf"apache(?: software)? license{_V} 2(?: 0)?|apache license v2(?: 0)?", r"apache 2 0"),
    ("apache-1.1", "apache", rf"apache(?: software)? license{_V} 1 1", r"apache 1 1"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2 clause|two clause|freebsd) bsd(?: license)?|bsd (?:2 clause|two clause)(?: license)?", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd(?: license)?|bsd (?:3 clause|three clause)(?: license)?", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd(?: license)?|bsd (?:4 clause|four clause)(?: license)?", r"bsd 4 clause"),
    ("bsd-0-clause", "bsd", r"(?:zero clause|0 clause) bsd(?: license)?", r"0bsd"),
    ("gpl-1", "general public", rf"gnu general public license{_V} 1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", "general public", rf"gnu general public license{_V} 2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3", "general public", rf"gnu general public license{_V} 3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "general public", rf"(?:gnu )?(?:library|lesser) general public license{_V} 2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "general public", rf"(?:gnu )?lesser general public license{_V} 2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "general public", rf"(?:gnu )?lesser general public license{_V} 3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "general public", rf"(?:gnu )?affero general public license(?:{_V} 3(?: 0)?)?", r"agpl 3 0(?: only| or later)?"),
    ("gfdl-1.3", "documentation", rf"gnu free documentation license(?:{_V} 1 [0-9])?", r"gfdl 1 [0-9](?: only| or later)?"),
    ("mpl-1.1", "mozilla", rf"mozilla public license{_V} 1 1", r"mpl 1 1"),
    ("mpl-2", "mozilla", rf"mozilla public license{_V} 2(?: 0)?", r"mpl 2 0"),
    ("epl-1", "eclipse", rf"eclipse public license{_V} 1(?: 0)?", r"epl 1 0"),
    ("epl-2", "eclipse", rf"eclipse public license{_V} 2(?: 0)?", r"epl 2 0"),
    ("cddl-1", "development and distribution", rf"common development and distribution license(?:{_V} 1(?: [01])?)?", r"cddl 1 [01]"),
    ("cpl-1", "common public", rf"common public license(?:{_V} 1(?: 0)?)?", r"cpl 1 0"),
    ("artistic-1", "artistic", r"artistic license(?: 1(?: 0)?)?", r"artistic 1 0"),
    ("artistic-2", "artistic", rf"artistic license{_V} 2(?: 0)?", r"artistic 2 0"),
    ("boost-1", "boost", rf"boost software license(?:{_V} 1(?: 0)?)?", r"bsl 1 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", r"zlib"),
    ("openssl", "openssl", r"openssl license", r"openssl"),
    ("python-2", "python", r"python software foundation license(?: version 2)?", r"psf 2 0|python 2 0"),
    ("python-2", "psf", r"psf license(?: version 2)?", None),
    ("php-3", "php", rf"php license(?:{_V} 3(?: 0[01]?)?)?", r"php 3 0[01]?"),
    ("ruby", "ruby", r"ruby license", r"ruby"),
    ("postgresql", "postgresql", r"postgresql license", r"postgresql"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source license", r"ncsa"),
    ("ms-pl", "microsoft", r"microsoft public license", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", r"ms rl"),
    ("eupl-1.2", "european union", rf"european union public licen[cs]e(?:{_V} 1 [12])?", r"eupl 1 [12]"),
    ("osl-3", "open software", rf"open software license(?:{_V} 3(?: 0)?)?", r"osl 3 0"),
    ("afl-3", "academic free", rf"academic free license(?:{_V} 3(?: 0)?)?", r"afl 3 0"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font license(?:{_V} 1 1)?", r"ofl 1 1"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl"),
    ("wtfpl", "you want to public license", r"do what the fuck you want to public license", None),
    ("cc0-1", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc-by-nc-sa", "by nc sa", r"(?:cc|creative commons) by nc sa(?: [1-4] [05])?", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "by nc nd", r"(?:cc|creative commons) by nc nd(?: [1-4] [05])?", r"cc by nc nd [1-4] [05]"),
    ("cc-by-nc", "by nc", r"(?:cc|creative commons) by nc(?: [1-4] [05])?", r"cc by nc [1-4] [05]"),
    ("cc-by-sa", "by sa", r"(?:cc|creative commons) by sa(?: [1-4] [05])?", r"cc by sa [1-4] [05]"),
    ("cc-by-nd", "by nd", r"(?:cc|creative commons) by nd(?: [1-4] [05])?", r"cc by nd [1-4] [05]"),
    ("cc-by", "by", r"(?:cc|creative commons) by(?: [1-4] [05])?", r"cc by [1-4] [05]"),
    ("odbl-1", "open database", rf"open database license(?:{_V} 1(?: 0)?)?", r"odbl 1 0"),
    ("odc-by-1", "attribution", r"open data commons attribution license", r"odc by 1 0"),
    ("pddl-1", "public domain dedication", r"public domain dedication and license", r"pddl 1 0"),
    ("cecill-2", "cecill", rf"cecill(?: free software)? licen[cs]e(?: agreement)?(?:{_V} 2(?: [01])?)?", r"cecill 2 [01]"),
    ("beerware", "beer", r"beer ?ware license", r"beerware"),
]
#: How a license is named: priority, and the words before its name.
WAYS = [
    (90, r"(?:licensed|released|distributed|available|provided|published|redistributed) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}"),
    (80, r"(?:subject to|governed by|covered by|according to|in accordance with|pursuant to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}"),
    (70, r"(?:under|by|see|accept|with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}"),
    (60, r"{name}"),
]
#: Sentences of licenses, notices and terms, each with a keyword that it contains: priority, keyword, words, label.
SENTENCES = [
    # MIT and its kin
    (93, "to deal in the software without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", "mit"),
    (92, "copies or substantial portions", r"(?:this permission notice|the above copyright notice and this permission notice) shall be included in all copies or substantial portions of the software", "mit"),
    (60, "without warranty of any kind express or implied", r"the software is provided as is without warranty of any kind express or implied", "mit"),
    (58, "in an action of contract tort or otherwise", r"in an action of contract tort or otherwise arising from out of or in connection with the software", "mit"),
    (93, "except as contained in this notice", r"except as contained in this notice the names? of the (?:x consortium|above copyright holders|authors) shall not be used in advertising", "x11"),
    (92, "provided that the above copyright notice", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice", "hpnd"),
    (92, "without fee is hereby granted", r"for any purpose with or without fee is hereby granted", "isc"),
    (91, "the author disclaims all warranties", r"the software is provided as is and the author disclaims all warranties", "isc"),
    (92, "without a written agreement", r"and without a written agreement is hereby granted", "postgresql"),
    (92, "creating derivative works", r"the copyright holders hereby grant the following permissions creating derivative works", "ncsa"),
    # BSD
    (93, "source code must retain", r"redistributions of source code must retain the (?:above )?copyright notice", "bsd"),
    (93, "binary form must reproduce", r"redistributions in binary form must reproduce the (?:above )?copyright notice", "bsd"),
    (94, "endorse or promote products", r"neither the names? of (?:the )?(?:copyright holders?|authors?|university|organization|company) nor the names of (?:its|their|any) contributors may be used to endorse or promote products", "bsd-3-clause"),
    (90, "endorse or promote products", r"may (?:not )?be used to endorse or promote products derived from this software", "bsd-3-clause"),
    (94, "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "bsd-4-clause"),
    (70, "provided by the copyright holders and contributors", r"this software is provided by the copyright holders and contributors as is", "bsd"),
    (70, "provided by the regents and contributors", r"this software is provided by the regents and contributors as is", "bsd"),
    (55, "implied warranties of merchantability", r"any express or implied warranties including but not limited to the implied warranties of merchantability", "bsd"),
    (55, "exemplary or consequential damages", r"any direct indirect incidental special exemplary or consequential damages", "bsd"),
    # Apache
    (93, "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2"),
    (93, "without warranties or conditions of any kind", r"without warranties or conditions of any kind either express or implied", "apache-2"),
    (94, "licensed to the apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements", "apache-2"),
    (94, "apache license version 2 0 january 2004", r"apache license version 2 0 january 2004", "apache-2"),
    (88, "no charge royalty free irrevocable", r"a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", "apache-2"),
    (90, "developed by the apache software foundation", r"this product includes software developed by the apache software foundation", "apache-1.1"),
    (80, "www apache org licenses", r"www apache org licenses license 2 0", "apache-2"),
    # GPL, LGPL, AGPL, GFDL
    (94, "terms of the gnu general public license as published", r"under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    (95, "either version 2 of the license", r"general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl-2"),
    (95, "either version 3 of the license", r"general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3"),
    (95, "terms of the gnu lesser general public license", r"under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    (95, "terms of the gnu library general public license", r"under the terms of the gnu library general public license as published by the free software foundation", "lgpl"),
    (95, "terms of the gnu affero general public license", r"under the terms of the gnu affero general public license as published by the free software foundation", "agpl-3"),
    (75, "distributed in the hope that it will be useful", r"(?:is|are) distributed in the hope that it will be useful but without any warranty", "gpl"),
    (85, "received a copy of the gnu general public license", r"you should have received a copy of the gnu general public license along with this program", "gpl"),
    (85, "received a copy of the gnu lesser general public license", r"you should have received a copy of the gnu lesser general public license along with this (?:library|program)", "lgpl"),
    (85, "received a copy of the gnu affero general public license", r"you should have received a copy of the gnu affero general public license along with this program", "agpl-3"),
    (90, "everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "gpl"),
    (92, "gnu general public license version 2 june 1991", r"gnu general public license version 2 june 1991", "gpl-2"),
    (92, "gnu general public license version 3 29 june 2007", r"gnu general public license version 3 29 june 2007", "gpl-3"),
    (92, "gnu affero general public license version 3 19 november 2007", r"gnu affero general public license version 3 19 november 2007", "agpl-3"),
    (92, "gnu lesser general public license version 2 1 february 1999", r"gnu lesser general public license version 2 1 february 1999", "lgpl-2.1"),
    (92, "gnu lesser general public license version 3 29 june 2007", r"gnu lesser general public license version 3 29 june 2007", "lgpl-3"),
    (80, "interacting with it remotely through a computer network", r"all users interacting with it remotely through a computer network", "agpl-3"),
    (70, "corresponding source", r"machine readable corresponding source", "gpl"),
    (93, "with no invariant sections", r"with no invariant sections no front cover texts and no back cover texts", "gfdl-1.3"),
    (80, "as a special exception", r"as a special exception the copyright holders? (?:of this library )?give you permission to link", "gpl-linking-exception"),
    (80, "gcc runtime library exception", r"gcc runtime library exception", "gcc-exception"),
    (80, "classpath exception", r"(?:gnu )?classpath exception", "classpath-exception"),
    (50, "gpl", r"gnu gpl|gpl license|gpl compatible", "gpl"),
    (50, "lgpl", r"gnu lgpl|lgpl license", "lgpl"),
    (50, "agpl", r"gnu agpl|agpl license", "agpl-3"),
    # Mozilla, Eclipse, CDDL, Microsoft, EUPL and others
    (95, "terms of the mozilla public license v 2 0", r"this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    (93, "if a copy of the mpl was not distributed", r"if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2"),
    (93, "subject to the mozilla public license version 1 1", r"the contents of this file are subject to the mozilla public license version 1 1", "mpl-1.1"),
    (85, "incompatible with secondary licenses", r"incompatible with secondary licenses as defined by the mozilla public license", "mpl-2"),
    (70, "covered software", r"all distribution of covered software in source code form", "mpl-2"),
    (94, "accompanying materials are made available under the terms of the eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v 1 0| v1 0)", "epl-1"),
    (94, "accompanying materials are made available under the terms of the eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v 2 0|v2 0|2 0)", "epl-2"),
    (94, "common development and distribution license the license", r"subject to the terms of the common development and distribution license the license", "cddl-1"),
    (90, "this license governs use of the accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license", "ms-pl"),
    (93, "licensed under the eupl", r"licensed under the eupl(?: version 1 [12]| v 1 [12])?", "eupl-1.2"),
    (93, "boost software license version 1 0 august 17th 2003", r"boost software license version 1 0 august 17th 2003", "boost-1"),
    (92, "person or organization obtaining a copy of the software", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "boost-1"),
    (94, "origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "zlib"),
    (92, "altered source versions must be plainly marked", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "zlib"),
    (91, "this software is provided as is without any express or implied warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib"),
    (93, "developed by the openssl project", r"this product includes software developed by the openssl project", "openssl"),
    (93, "cryptographic software written by eric young", r"this product includes cryptographic software written by eric young", "ssleay"),
    (92, "python software foundation all rights reserved", r"python software foundation all rights reserved", "python-2"),
    (92, "subject to version 3 01 of the php license", r"this source file is subject to version 3 01 of the php license", "php-3"),
    (92, "under the same terms as perl itself", r"(?:modify it|and or modify it) under the same terms as perl itself", "perl-5"),
    (92, "source form of the standard version", r"verbatim copies of the source form of the standard version of this package", "artistic-1"),
    (94, "reserved font name", r"with reserved font name", "ofl-1.1"),
    (94, "this font software is licensed under the sil open font license", r"this font software is licensed under the sil open font license version 1 1", "ofl-1.1"),
    (94, "do what the fuck you want to", r"you just do what the fuck you want to", "wtfpl"),
    (94, "you can buy me a beer in return", r"you think this stuff is worth it you can buy me a beer in return", "beerware"),
    (95, "free and unencumbered software released into the public domain", r"this is free and unencumbered software released into the public domain", "unlicense"),
    (92, "dedicate any and all copyright interest", r"dedicate any and all copyright interest in the software to the public domain", "unlicense"),
    (90, "the author disclaims copyright to this source code", r"the author disclaims copyright to this source code", "blessing"),
    (85, "universal permissive license", r"universal permissive license(?: v| version)? 1 0", "upl-1"),
    (85, "server side public license", r"server side public license(?: v 1| version 1)?", "sspl-1"),
    (85, "business source license", r"business source license(?: 1 1| version 1 1)?", "busl-1.1"),
    (85, "elastic license", r"elastic license(?: 2 0| v2| version 2)?", "elastic-2"),
    (85, "commons clause", r"commons clause(?: license)? condition v1 0|commons clause restriction", "commons-clause"),
    (85, "polyform noncommercial license", r"polyform noncommercial license 1 0 0", "polyform-noncommercial-1"),
    (85, "vim license", r"vim license", "vim"),
    (85, "curl license", r"curl license", "curl"),
    (85, "w3c software notice", r"w3c software notice and license", "w3c"),
    (85, "unicode license agreement", r"unicode license agreement data files and software", "unicode"),
    (85, "mulan permissive software license", r"mulan permissive software license(?: v2| version 2)?", "mulanpsl-2"),
    (85, "blue oak model license", r"blue oak model license(?: 1 0 0)?", "blueoak-1"),
    (85, "hippocratic license", r"hippocratic license", "hippocratic"),
    (85, "upstream compatibility license", r"upstream compatibility license", "ucl-1"),
    (85, "sleepycat license", r"sleepycat license", "sleepycat"),
    (85, "ibm public license", r"ibm public license(?: version 1 0)?", "ipl-1"),
    (85, "lucent public license", r"lucent public license(?: version 1 02)?", "lpl-1.02"),
    (85, "nasa open source agreement", r"nasa open source agreement(?: version 1 3)?", "nasa-1.3"),
    (85, "reciprocal public license", r"reciprocal public license(?: 1 5)?", "rpl-1.5"),
    (85, "sun public license", r"sun public license(?: version 1 0)?", "spl-1"),
    (85, "q public license", r"q public license(?: version 1 0)?", "qpl-1"),
    (85, "academic free license", r"academic free license version 2 1", "afl-2.1"),
    (85, "apple public source license", r"apple public source license(?: version 2 0)?", "apsl-2"),
    (85, "latex project public license", r"latex project public license", "lppl"),
    (85, "zope public license", r"zope public license(?: version 2 [01])?", "zpl-2"),
    (85, "open government licence", r"open government licence(?: v3 0| v2 0)?", "ogl"),
    # models and data
    (88, "openrail", r"(?:creativeml |bigscience |bigcode )?openrail(?: m| license)", "openrail"),
    (88, "community license agreement", r"llama (?:2|3) community license agreement", "llama"),
    (88, "community data license agreement", r"community data license agreement (?:permissive|sharing)", "cdla"),
    (85, "made available under the open database license", r"made available under the open database license", "odbl-1"),
    # Creative Commons
    (92, "licensed under a creative commons", r"(?:is|are) licensed under a creative commons attribution(?: [1-4] [05])? (?:international|unported|generic) license", "cc-by"),
    (92, "commons attribution noncommercial sharealike", r"creative commons attribution noncommercial sharealike(?: [1-4] [05])?", "cc-by-nc-sa"),
    (92, "commons attribution noncommercial noderivs", r"creative commons attribution noncommercial noderivs(?: [1-4] [05])?", "cc-by-nc-nd"),
    (92, "commons attribution noncommercial noderivatives", r"creative commons attribution noncommercial noderivatives(?: [1-4] [05])?", "cc-by-nc-nd"),
    (90, "commons attribution non commercial", r"creative commons attribution non commercial(?: [1-4] [05])?", "cc-by-nc"),
    (90, "commons attribution noderivatives", r"creative commons attribution noderivatives(?: [1-4] [05])?", "cc-by-nd"),
    (90, "commons attribution no derivatives", r"creative commons attribution no derivatives(?: [1-4] [05])?", "cc-by-nd"),
    (92, "creativecommons org publicdomain zero", r"creativecommons org publicdomain zero 1 0", "cc0-1"),
    (92, "creativecommons org publicdomain mark", r"creativecommons org publicdomain mark 1 0", "public-domain"),
    (92, "creativecommons org licenses by nc sa", r"creativecommons org licenses by nc sa [1-4] [05]", "cc-by-nc-sa"),
    (92, "creativecommons org licenses by nc nd", r"creativecommons org licenses by nc nd [1-4] [05]", "cc-by-nc-nd"),
    (92, "creativecommons org licenses by nc", r"creativecommons org licenses by nc [1-4] [05]", "cc-by-nc"),
    (92, "creativecommons org licenses by sa", r"creativecommons org licenses by sa [1-4] [05]", "cc-by-sa"),
    (92, "creativecommons org licenses by nd", r"creativecommons org licenses by nd [1-4] [05]", "cc-by-nd"),
    (92, "creativecommons org licenses by", r"creativecommons org licenses by [1-4] [05]", "cc-by"),
    (90, "has waived all copyright", r"has waived all copyright and related or neighboring rights", "cc0-1"),
    (90, "to the extent possible under law", r"to the extent possible under law the (?:author|person) (?:s )?(?:who associated cc0 with this work )?has waived", "cc0-1"),
    # no free license
    (60, "unauthorized copying of this file", r"unauthorized copying of this file via any medium is strictly prohibited", "proprietary"),
    (60, "may not be reproduced", r"may not be reproduced (?:or transmitted |distributed )?(?:in any form )?without (?:the )?(?:prior |express )?(?:written )?permission", "all-rights-reserved"),
    (60, "trade secrets", r"contains (?:confidential information and )?trade secrets", "proprietary"),
    (60, "this software is the confidential and proprietary information", r"this software is the confidential and proprietary information of", "proprietary"),
    (60, "for non commercial use only", r"for non commercial use only", "non-commercial"),
    (60, "for noncommercial use only", r"for noncommercial use only", "non-commercial"),
    (60, "personal and evaluation", r"for personal and evaluation (?:purposes|use) only", "evaluation"),
    (55, "end user license agreement", r"end user license agreement", "eula"),
    (55, "commercial license", r"commercial license", "commercial"),
    (45, "no license is granted", r"no license is granted(?: by implication| by estoppel)?", "no-license"),
    (45, "reproduced with permission", r"reproduced with permission", "permission"),
    (45, "used by permission", r"reproduced and used by permission", "permission"),
    # lines of copyright
    (42, "copyright c", r"copyright c (?:19|20)[0-9][0-9]", "copyright-notice"),
    (42, "copyright holder", r"the copyright holders?", "copyright-notice"),
    (42, "copyright notice", r"(?:the above|this) copyright notice", "copyright-notice"),
]
#: Rules of their own: priority, keyword, words, label.
OTHERS = [
    (95, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    (95, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    (95, "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    (95, "you may not use", r"you may not use this file except in compliance with the license", "apache"),
    (95, "free software", r"this program is free software you can redistribute it and or modify it", "gpl"),
    (50, "general public", r"(?:gnu )?general public license", "gpl"),
    (50, "gpl", r"gplv2", "gpl-2"),
    (50, "gpl", r"gplv3", "gpl-3"),
    (50, "bsd", r"bsd license", "bsd"),
    (50, "apache", r"apache(?: software)? license", "apache"),
    (50, "creative commons", r"creative commons(?: attribution)?(?: license)?", "creative-commons"),
    (50, "attribution", r"creative commons attribution noncommercial(?: [1-4] [05])?", "cc-by-nc"),
    (50, "attribution", r"creative commons attribution share ?alike(?: [1-4] [05])?", "cc-by-sa"),
    (40, "rights reserved", r"all rights reserved", "all-rights-reserved"),
    (40, "public domain", r"(?:released into|placed in|in) the public domain", "public-domain"),
    (40, "proprietary", r"proprietary and confidential|proprietary license", "proprietary"),
    (40, "copyleft", r"copyleft", "copyleft"),
]


#: Whatever a rule matches has all strings of one of these: a set of STEMS, or the three longest words of the keyword of a
#: sentence that has none.
GATES = [*STEMS, *(sorted(dict.fromkeys(key.split()), key=len, reverse=True)[:3] for key in dict.fromkeys(k for _, k, _, _ in SENTENCES) if not any(all(x in key for x in stem) for stem in STEMS))]


def _cover(gates: list[list[str]], size: int = 5) -> list[str]:
    """A few short strings: each gate has one of them in its strings. The one that most gates have is taken first, of
    equals that of the earlier gate and string."""
    parts = [dict.fromkeys(x[i : i + size] for x in g for i in range(max(1, len(x) - size + 1))) for g in gates]
    out: list[str] = []
    while parts:
        best = max({k: None for p in parts for k in p}, key=lambda k: sum(k in p for p in parts))
        out.append(best)
        parts = [p for p in parts if best not in p]
    return out


#: A text without any of these is done at once; of others the gates are looked at.
FIRST = _cover(GATES)


def rules() -> list[dict]:
    """All rules, the highest rank first. keyword: a string of the words; words: an expression that starts at a word's space."""
    whole = lambda words: f" (?:{words})(?= )"
    out = [{"k": phrase, "p": whole(phrase), "prio": 100, "label": label, "base": 1} for phrase, label in BASE.items()]
    out += [{"k": "spdx", "p": whole(rf"spdx license identifier (?:{short})"), "prio": 98, "label": label, "base": 0} for label, _, _, short in NAMES if short]
    out += [{"k": key, "p": whole(way.format(name=f"(?:{name})")), "prio": prio, "label": label, "base": 0} for prio, way in WAYS for label, key, name, _ in NAMES]
    out += [{"k": key, "p": whole(words), "prio": prio, "label": label, "base": 0} for prio, key, words, label in [*SENTENCES, *OTHERS]]
    out.sort(key=lambda r: -r["prio"])
    return [r | {"rank": i} for i, r in enumerate(out)]


RULE_TYPE = "array<struct<k:string,p:string,prio:int,label:string,base:int,rank:int>>"


def normal(text: Column) -> Column:
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATORS, " ")), F.lit(" "))


#: Mark the place before a match, and its end; no text has these characters once it is normalised.
OPEN, CLOSE = "\x01", "\x02"


def _places(norm: Column, rule: Column) -> Column:
    """A detection for each match of a rule, from left to right, in words from 0."""
    at = lambda words, mark: F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)), lambda i: i.isNotNull())
    one = lambda start, end: F.struct(start.alias("start"), (-end).alias("neg_end"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["prio"].alias("prio"), rule["base"].alias("base"))
    # a match begins with the space before its first word, so OPEN ends the word before; words of a split count from 1
    marked = F.split(F.regexp_replace(norm, rule["p"], F.lit(f"{OPEN}$0{CLOSE}")), " ", -1)
    return let(marked, lambda words: F.zip_with(at(words, OPEN), at(words, CLOSE), one))


DETECTIONS = "array<struct<start:int,neg_end:int,rank:int,label:string,prio:int,base:int>>"


def detections(norm: Column, table: Column) -> Column:
    """All detections in order: start, then the longer, then the higher rank."""
    some = F.filter(table, lambda r: F.contains(norm, r["k"]))
    return F.array_sort(F.flatten(F.transform(some, lambda r: _places(norm, r))))


def survivors(ordered: Column) -> Column:
    """The detections that are in no other one of a higher rank."""

    def step(acc: Column, d: Column) -> Column:
        live = F.filter(acc["live"], lambda e: e["neg_end"] < -d["start"])
        hidden = F.exists(live, lambda e: (e["neg_end"] <= d["neg_end"]) & (e["rank"] < d["rank"]))
        return F.struct(F.concat(live, F.array(d)).alias("live"), F.when(hidden, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    none = F.array().cast(DETECTIONS)
    return F.aggregate(ordered, F.struct(none.alias("live"), none.alias("kept")), step, lambda acc: acc["kept"])


def find(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with n_words, all detections and those kept.

    A detection is a struct of start and neg_end (minus the exclusive end) in words from 0, rank, label, prio (0 to
    100) and base (1: a phrase of BASE). Returns the frame and the names of these columns, which differ only where docs
    has such a name. A null or empty text has no words and no detections. Whole texts are scanned, however long; equal
    texts get equal results.
    """
    names = {k: fresh(docs, k) for k in ("n_words", "detections", "kept")}
    row = fresh(docs, "whole_row")
    model = F.from_json(F.lit(json.dumps(rules())), RULE_TYPE)
    gate = lambda t: F.array_contains(F.array(*(F.forall(F.array(*map(F.lit, g)), lambda k: F.contains(t, k)) for g in GATES)), True)
    first = functools.reduce(operator.or_, (F.contains("low_text", F.lit(k)) for k in FIRST))
    out = docs.select(F.struct(*docs.columns).alias(row), F.coalesce(F.col(text), F.lit("")).alias("scanned_text"))
    out = out.select(row, "scanned_text", F.regexp_count("scanned_text", F.lit(WORD)).cast("long").alias(names["n_words"]), F.lower("scanned_text").alias("low_text"))
    out = out.select(row, "scanned_text", names["n_words"], (first & let(F.col("low_text"), gate)).alias("gated"))
    found = F.when(F.col("gated"), let(normal(F.col("scanned_text")), lambda n: detections(n, model))).otherwise(F.array().cast(DETECTIONS))
    out = out.select(row, names["n_words"], found.alias(names["detections"]))
    out = out.select(row, *(names[k] for k in ("n_words", "detections")), F.when(F.size(names["detections"]) > 0, survivors(F.col(names["detections"]))).otherwise(F.array().cast(DETECTIONS)).alias(names["kept"]))
    return out.select(f"{row}.*", *names.values()), names
