"""Sentences of licence texts, grants, headers and disclaimers, each written by hand as an expression over normalised text.

Fields: label, keyword, expression, priority, weight. The keyword is part of every match.
"""

from __future__ import annotations

SENTENCES = [
    # MIT and its relatives
    ("mit", "hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1, 1.0),
    ("mit", "deal in the software without restriction", "(?:to )?deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", 1, 1.0),
    ("mit", "deal in the materials without restriction", "deal in the materials without restriction", 2, 0.9),
    ("mit", "this permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the (?:software|materials)", 1, 1.0),
    ("mit", "this permission notice including the next paragraph", "this permission notice including the next paragraph shall be included in all copies", 1, 1.0),
    ("mit", "released under the mit", "(?:is )?released under the mit(?: licen[cs]e)?", 2, 0.95),
    ("mit", "licensed under the mit", "(?:is )?licensed under the mit(?: licen[cs]e)?", 2, 0.95),
    ("mit", "under the terms of the mit", "under the terms of the mit licen[cs]e", 2, 0.95),
    ("mit", "distributed under the mit", "distributed under the mit(?: licen[cs]e)?", 2, 0.95),
    ("mit", "spdx license identifier mit", "spdx license identifier mit", 1, 1.0),
    ("mit", "opensource org licenses mit", "(?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php)?", 1, 1.0),
    ("mit-modern-variant", "without written agreement", "permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute", 1, 0.95),
    ("mit-cmu", "supporting documentation and that the name", "appear in supporting documentation and that the name of .{1,80} not be used in advertising", 1, 0.9),
    ("mit-advertising", "mit advertising", "mit advertising licen[cs]e", 2, 0.9),
    ("mit-0", "spdx license identifier mit 0", "spdx license identifier mit 0", 1, 1.0),
    ("x11", "x11 licen", "(?:the )?x11 licen[cs]e", 3, 0.9),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium shall not be used", 1, 1.0),
    ("expat", "expat licen", "(?:the )?expat licen[cs]e", 3, 0.9),
    ("ncsa", "ncsa open source licen", "(?:university of illinois )?ncsa open source licen[cs]e", 2, 0.95),
    ("jsonlicense", "used for good not evil", "the software shall be used for good not evil", 1, 1.0),
    # ISC, historical permission notices
    ("isc", "with or without fee is hereby granted", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 1, 1.0),
    ("isc", "provided that the above copyright notice and this permission notice appear", "provided that the above copyright notice and this permission notice appear in all copies", 1, 0.95),
    ("isc", "spdx license identifier isc", "spdx license identifier isc", 1, 1.0),
    ("hpnd", "documentation for any purpose and without fee", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", 1, 0.95),
    ("hpnd", "historical permission notice", "historical permission notice and disclaimer", 2, 0.9),
    ("0bsd", "for any purpose with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 2, 0.8),
    ("0bsd", "zero clause bsd", "zero clause bsd(?: licen[cs]e)?", 2, 0.95),
    ("0bsd", "spdx license identifier 0bsd", "spdx license identifier 0bsd", 1, 1.0),
    ("ntp", "ntp licen", "ntp licen[cs]e", 3, 0.8),
    # BSD
    ("bsd", "with or without modification are permitted", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 1, 1.0),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 1, 1.0),
    ("bsd", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 1, 1.0),
    ("bsd-3-clause", "neither the name of", "neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products", 1, 1.0),
    ("bsd-3-clause", "names of its contributors may be used to endorse", "names of its contributors may be used to endorse or promote products derived from this software", 2, 0.95),
    ("bsd-4-clause", "all advertising materials mentioning features", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1, 1.0),
    ("bsd", "use of this source code is governed by a bsd", "use of this source code is governed by a bsd style license", 1, 0.95),
    ("bsd", "bsd", "bsd (?:style|like|type) licen[cs]e", 3, 0.8),
    ("bsd", "bsd", "(?:released|licensed|distributed) under the (?:terms of the )?bsd(?: licen[cs]e)?", 2, 0.9),
    ("bsd-3-clause", "modified bsd", "(?:the )?modified bsd(?: licen[cs]e)?", 2, 0.9),
    ("bsd-3-clause", "revised bsd", "(?:the )?revised bsd(?: licen[cs]e)?", 2, 0.9),
    ("bsd-2-clause", "freebsd licen", "(?:the )?freebsd licen[cs]e", 2, 0.9),
    ("bsd-4-clause", "original bsd", "(?:the )?original bsd(?: licen[cs]e)?", 2, 0.9),
    ("bsd-3-clause-clear", "clear bsd", "(?:the )?clear bsd(?: licen[cs]e)?", 2, 0.9),
    ("bsd-2-clause-patent", "bsd 2 clause plus patent", "bsd 2 clause plus patent(?: licen[cs]e)?", 1, 0.95),
    ("bsd-2-clause", "spdx license identifier bsd 2", "spdx license identifier bsd 2 clause", 1, 1.0),
    ("bsd-3-clause", "spdx license identifier bsd 3", "spdx license identifier bsd 3 clause", 1, 1.0),
    ("bsd-3-clause", "opensource org licenses bsd 3", "opensource org licenses bsd 3 clause", 1, 1.0),
    ("bsd-2-clause", "opensource org licenses bsd 2", "opensource org licenses bsd 2 clause", 1, 1.0),
    # GNU
    ("gpl", "it under the terms of the gnu general public", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 1, 1.0),
    ("gpl-2.0-or-later", "version 2 of the license or", "(?:either )?version 2 of the license or (?:at your option )?any later version", 1, 1.0),
    ("gpl-3.0-or-later", "version 3 of the license or", "(?:either )?version 3 of the license or (?:at your option )?any later version", 1, 1.0),
    ("gpl", "you should have received a copy of the gnu general public", "you should have received a copy of the gnu general public license along with this (?:program|library|file)", 1, 1.0),
    ("lgpl", "you should have received a copy of the gnu lesser", "you should have received a copy of the gnu lesser general public license along with this (?:program|library|file)", 1, 1.0),
    ("agpl", "you should have received a copy of the gnu affero", "you should have received a copy of the gnu affero general public license along with this (?:program|library|file)", 1, 1.0),
    ("lgpl", "it under the terms of the gnu lesser", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", 1, 1.0),
    ("lgpl", "it under the terms of the gnu library", "you can redistribute it and or modify it under the terms of the gnu library general public license", 1, 1.0),
    ("agpl", "it under the terms of the gnu affero", "you can redistribute it and or modify it under the terms of the gnu affero general public license", 1, 1.0),
    ("gpl", "preamble the licenses for most software", "preamble the licenses for most software are designed to take away your freedom to share and change it", 1, 1.0),
    ("gpl-3.0", "is a free copyleft license for software", "the gnu general public license is a free copyleft license for software and other kinds of works", 1, 1.0),
    ("gpl", "incorporating your program into proprietary", "does not permit incorporating your program into proprietary programs", 2, 0.95),
    ("gpl", "everyone is permitted to copy and distribute verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 2, 0.9),
    ("gpl", "www gnu org licenses", "(?:https? )?www gnu org licenses(?: gpl)?(?: html| txt)?", 3, 0.8),
    ("gpl-2.0", "gnu org licenses old licenses gpl 2", "(?:https? )?(?:www )?gnu org licenses old licenses gpl 2 0", 1, 1.0),
    ("gpl-2.0-only", "spdx license identifier gpl 2", "spdx license identifier gpl 2 0(?: only)?(?! or)", 1, 1.0),
    ("gpl-2.0-or-later", "spdx license identifier gpl 2 0 or later", "spdx license identifier gpl 2 0 or later", 1, 1.0),
    ("gpl-3.0-only", "spdx license identifier gpl 3", "spdx license identifier gpl 3 0(?: only)?(?! or)", 1, 1.0),
    ("gpl-3.0-or-later", "spdx license identifier gpl 3 0 or later", "spdx license identifier gpl 3 0 or later", 1, 1.0),
    ("lgpl-2.1", "spdx license identifier lgpl 2", "spdx license identifier lgpl 2 1(?: only| or later)?", 1, 1.0),
    ("lgpl-3.0", "spdx license identifier lgpl 3", "spdx license identifier lgpl 3 0(?: only| or later)?", 1, 1.0),
    ("agpl-3.0", "spdx license identifier agpl 3", "spdx license identifier agpl 3 0(?: only| or later)?", 1, 1.0),
    ("gpl-classpath-exception", "classpath exception", "(?:with (?:the )?)?(?:gnu )?classpath exception", 2, 0.95),
    ("gpl-gcc-exception", "gcc runtime library exception", "gcc runtime library exception", 2, 0.95),
    ("gpl-linking-exception", "linking exception", "(?:gpl )?linking exception", 3, 0.8),
    ("gpl-bison-exception", "bison exception", "bison exception", 3, 0.8),
    ("gpl-font-exception", "font exception", "gpl font exception", 2, 0.9),
    ("gpl", "dual licensed under the mit and gpl", "dual licensed under the mit and gpl(?: licen[cs]es)?", 1, 0.95),
    ("gfdl", "permission is granted to copy distribute and or modify this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1, 1.0),
    ("gfdl", "with no invariant sections", "with no invariant sections no front cover texts and no back cover texts", 1, 0.95),
    # Apache
    ("apache-2.0", "you may not use this file except in compliance", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1, 1.0),
    ("apache-2.0", "apache org licenses license 2 0", "(?:https? )?www apache org licenses license 2 0(?: txt| html)?", 1, 1.0),
    ("apache-2.0", "licensed to the apache software foundation", "licensed to the apache software foundation asf under one or more contributor license agreements", 1, 1.0),
    ("apache-2.0", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 2, 0.9),
    ("apache-2.0", "see the license for the specific language", "see the license for the specific language governing permissions and limitations under the license", 2, 0.9),
    ("apache-2.0", "terms and conditions for use reproduction and distribution", "terms and conditions for use reproduction and distribution", 3, 0.8),
    ("apache-2.0", "apache 2", "apache 2(?: 0)? licen[cs]ed?", 2, 0.95),
    ("apache-2.0", "spdx license identifier apache", "spdx license identifier apache 2 0", 1, 1.0),
    ("apache-1.1", "this product includes software developed by the apache", "this product includes software developed by the apache (?:software foundation|group)", 2, 0.9),
    ("apache-2.0-llvm-exception", "apache 2 0 with llvm", "apache 2 0 with llvm exceptions?", 1, 1.0),
    # Mozilla, Eclipse and other weak copyleft
    ("mpl-2.0", "this source code form is subject to", "this source code form is subject to the terms of the mozilla public license v 2 0", 1, 1.0),
    ("mpl-2.0", "mozilla org mpl 2", "(?:https? )?(?:www )?mozilla org mpl 2 0", 1, 1.0),
    ("mpl-1.1", "the contents of this file are subject to the mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 1, 1.0),
    ("mpl-1.0", "the contents of this file are subject to the mozilla public license version 1 0", "the contents of this file are subject to the mozilla public license version 1 0", 1, 1.0),
    ("mpl", "incompatible with secondary licenses", "this source code form is incompatible with secondary licenses", 2, 0.95),
    ("mpl-2.0", "spdx license identifier mpl", "spdx license identifier mpl 2 0", 1, 1.0),
    ("npl", "netscape public licen", "netscape public licen[cs]e(?: version)?(?: 1 [01])?", 2, 0.95),
    ("epl-1.0", "accompanying materials are made available under the terms of the eclipse public license v1", "accompanying materials are made available under the terms of the eclipse public license v1 0", 1, 1.0),
    ("epl-2.0", "accompanying materials are made available under the terms of the eclipse public license 2", "accompanying materials are made available under the terms of the eclipse public license 2 0", 1, 1.0),
    ("epl", "eclipse org legal epl", "(?:https? )?(?:www )?eclipse org legal epl(?: v10| v20| 2 0)?(?: html)?", 2, 0.95),
    ("edl-1.0", "eclipse distribution licen", "eclipse distribution licen[cs]e(?: v ?1 0)?", 2, 0.95),
    ("cddl-1.0", "subject to the terms of the common development", "the contents of this file are subject to the terms of the common development and distribution license", 1, 1.0),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public", "the accompanying program is provided under the terms of this common public license", 1, 1.0),
    ("ipl-1.0", "ibm public licen", "ibm public licen[cs]e(?: version)?(?: 1 0)?", 2, 0.95),
    ("spl-1.0", "sun public licen", "sun public licen[cs]e(?: version)?(?: 1 0)?", 2, 0.95),
    ("sissl", "sun industry standards source licen", "sun industry standards source licen[cs]e", 2, 0.95),
    ("apsl-2.0", "apple public source licen", "apple public source licen[cs]e(?: version)?(?: 2 0)?", 2, 0.95),
    ("qpl-1.0", "q public licen", "q public licen[cs]e(?: version)?(?: 1 0)?", 2, 0.95),
    ("rpl-1.5", "reciprocal public licen", "reciprocal public licen[cs]e(?: version)?(?: 1 [15])?", 2, 0.95),
    ("ms-pl", "this license governs use of the accompanying software", "this license governs use of the accompanying software if you use the software you accept this license", 1, 0.95),
    ("cpal-1.0", "common public attribution licen", "common public attribution licen[cs]e(?: version)?(?: 1 0)?", 2, 0.95),
    ("eupl-1.2", "licensed under the eupl", "licensed under the eupl(?: version)?(?: v?1 [012])?", 1, 0.95),
    ("eupl", "european union public licence", "european union public licence", 3, 0.9),
    ("osl-3.0", "licensed under the open software license", "licensed under the open software license version 3 0", 1, 1.0),
    ("afl-3.0", "licensed under the academic free license", "licensed under the academic free license version 3 0", 1, 1.0),
    ("cecill", "par la licence cecill", "ce logiciel est r[eé]gi par la licence cecill", 1, 1.0),
    ("cecill-b", "cecill b", "cecill b(?: licen[cs]e)?", 2, 0.9),
    ("cecill-c", "cecill c", "cecill c(?: licen[cs]e)?", 2, 0.9),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document", "the artistic license 2 0 copyright c 2000 2006 the perl foundation everyone is permitted to copy and distribute verbatim copies of this license document", 1, 1.0),
    ("artistic", "under the same terms as perl itself", "(?:redistribute it and or modify it )?under the same terms as perl itself", 1, 0.9),
    ("perl", "gnu general public license or the artistic", "gnu general public license or the artistic license", 1, 0.95),
    # Boost, zlib, Python and others
    ("bsl-1.0", "distributed under the boost software", "distributed under the boost software license version 1 0", 1, 1.0),
    ("bsl-1.0", "boost org license 1 0", "(?:https? )?(?:www )?boost org license 1 0 txt", 1, 1.0),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 1, 1.0),
    ("bsl-1.0", "spdx license identifier bsl", "spdx license identifier bsl 1 0", 1, 1.0),
    ("zlib", "permission is granted to anyone to use this software for any purpose", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 1, 1.0),
    ("zlib", "origin of this software must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1, 1.0),
    ("zlib", "altered source versions must be plainly mar", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1, 1.0),
    ("zlib", "spdx license identifier zlib", "spdx license identifier zlib", 1, 1.0),
    ("libpng", "libpng licen", "libpng licen[cs]e(?: version 2)?", 2, 0.9),
    ("psf-2.0", "psf license agreement", "psf license agreement(?: for python)?", 1, 0.95),
    ("psf-2.0", "python software foundation license version", "python software foundation license version 2", 1, 1.0),
    ("python-cnri", "cnri", "cnri (?:open source )?licen[cs]e agreement", 2, 0.9),
    ("php-3.01", "this product includes php software", "this product includes php software freely available from", 1, 1.0),
    ("php-3.01", "subject to version 3 01 of the php license", "this source file is subject to version 3 01 of the php license", 1, 1.0),
    ("openssl", "developed by the openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit", 1, 1.0),
    ("ssleay", "cryptographic software written by eric young", "this product includes cryptographic software written by eric young", 1, 1.0),
    ("curl", "curl licen", "(?:the )?curl licen[cs]e", 2, 0.9),
    ("icu", "icu licen", "icu licen[cs]e", 2, 0.9),
    ("unicode-dfs", "unicode data files or unicode software", "unicode data files or unicode software", 2, 0.9),
    ("unicode-dfs", "unicode licen", "unicode licen[cs]e(?: agreement)?", 2, 0.9),
    ("w3c", "w3c software", "w3c software (?:notice and|and document notice and) license", 1, 0.95),
    ("w3c", "w3c licen", "w3c licen[cs]e", 3, 0.8),
    ("ftl", "freetype project licen", "(?:the )?freetype project licen[cs]e", 1, 0.95),
    ("ijg", "independent jpeg group", "this software is based in part on the work of the independent jpeg group", 1, 0.95),
    ("bzip2", "bzip2 licen", "bzip2 licen[cs]e", 2, 0.9),
    ("sleepycat", "sleepycat licen", "(?:the )?sleepycat licen[cs]e", 2, 0.95),
    ("vim", "vim licen", "(?:the )?vim licen[cs]e", 2, 0.9),
    ("tcl", "tcl tk licen", "tcl tk licen[cs]e", 2, 0.9),
    ("beerware", "beer ware licen", "the beer ware licen[cs]e(?: revision 42)?", 1, 1.0),
    ("beerware", "you can buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", 1, 1.0),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", 1, 1.0),
    ("unlicense", "anyone is free to copy modify publish", "anyone is free to copy modify publish use compile sell or distribute this software", 1, 1.0),
    ("unlicense", "unlicense org", "(?:https? )?(?:www )?unlicense org", 2, 0.95),
    ("unlicense", "spdx license identifier unlicense", "spdx license identifier unlicense", 1, 1.0),
    ("blessing", "may you do good and not evil", "may you do good and not evil may you find forgiveness for yourself and forgive others", 1, 1.0),
    ("blueoak-1.0.0", "blue oa", "blue oak model licen[cs]e(?: 1 0 0)?", 2, 0.95),
    ("upl-1.0", "universal permissive licen", "universal permissive licen[cs]e(?: v)?(?: 1 0)?", 2, 0.95),
    ("mulanpsl-2.0", "mulan psl", "mulan psl v2", 1, 1.0),
    ("ecl-2.0", "educational community licen", "educational community licen[cs]e(?: version)?(?: 2 0)?", 2, 0.95),
    ("vsl-1.0", "vovida software licen", "vovida software licen[cs]e", 2, 0.9),
    ("intel", "intel open source licen", "intel open source licen[cs]e", 2, 0.9),
    ("naumen", "naumen public licen", "naumen public licen[cs]e", 2, 0.9),
    ("nasa-1.3", "nasa open source agreement", "nasa open source agreement(?: version)?(?: 1 3)?", 2, 0.95),
    ("ofl-1.1", "this font software is licensed under the sil open font", "this font software is licensed under the sil open font license version 1 1", 1, 1.0),
    ("ofl-1.1", "scripts sil org ofl", "(?:https? )?scripts sil org ofl", 2, 0.95),
    # Creative Commons and open data
    ("cc0-1.0", "to the extent possible under law", "to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights", 1, 1.0),
    ("cc0-1.0", "creativecommons org publicdomain zero", "(?:https? )?creativecommons org publicdomain zero 1 0", 1, 1.0),
    ("cc0-1.0", "creative commons zero", "creative commons zero(?: v?1 0)?(?: universal)?", 2, 0.95),
    ("cc-pdm", "creativecommons org publicdomain mar", "(?:https? )?creativecommons org publicdomain mark 1 0", 1, 1.0),
    ("cc-by", "licensed under a creative commons attribution", "(?:this work is )?licensed under a creative commons attribution(?! non| share| no)", 2, 0.9),
    ("cc-by-sa", "licensed under a creative commons attribution share", "(?:this work is )?licensed under a creative commons attribution share ?alike", 1, 0.95),
    ("cc-by-nc", "licensed under a creative commons attribution non", "(?:this work is )?licensed under a creative commons attribution non ?commercial(?! share| no)", 1, 0.95),
    ("cc-by-sa", "share adapt the material under the same", "share adapt the material under the same license", 3, 0.6),
    ("cc", "some rights reserved", "some rights reserved", 4, 0.4),
    ("cc", "creative commons licen", "(?:a |the )?creative commons licen[cs]e", 4, 0.5),
    ("odbl-1.0", "opendatacommons org licenses odbl", "(?:https? )?(?:www )?opendatacommons org licenses odbl", 1, 1.0),
    ("odc-by-1.0", "opendatacommons org licenses by", "(?:https? )?(?:www )?opendatacommons org licenses by", 1, 1.0),
    ("pddl-1.0", "opendatacommons org licenses pddl", "(?:https? )?(?:www )?opendatacommons org licenses pddl", 1, 1.0),
    ("cdla-permissive", "community data license agreement permissive", "community data license agreement permissive(?: version)?(?: [12] 0)?", 1, 0.95),
    ("cdla-sharing", "community data license agreement sharing", "community data license agreement sharing(?: version)?(?: 1 0)?", 1, 0.95),
    ("ogl-uk-3.0", "open government licen", "open government licen[cs]e(?: v)?(?: ?3 0)?", 2, 0.95),
    ("public-domain", "dedicated to the public domain", "(?:is |has been )?dedicated to the public domain", 2, 0.9),
    ("public-domain", "no copyright is claimed", "no copyright is claimed", 3, 0.6),
    ("public-domain", "placed in the public domain", "(?:is |has been |hereby )?placed in the public domain", 2, 0.9),
    # Models, source-available and commercial terms
    ("openrail", "openrail", "(?:bigscience |creativeml |bigcode )?openrail(?: m)?(?: licen[cs]e)?", 2, 0.9),
    ("busl-1.1", "business source licen", "business source licen[cs]e(?: version)?(?: 1 1)?", 2, 0.95),
    ("sspl-1.0", "server side public licen", "server side public licen[cs]e(?: version)?(?: 1)?", 2, 0.95),
    ("elastic-2.0", "elastic licen", "elastic licen[cs]e(?: version)?(?: 2 0)?", 2, 0.9),
    ("commons-clause", "commons clause", "commons clause(?: licen[cs]e condition)?", 2, 0.9),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e", 2, 0.95),
    ("confluent-community", "confluent community licen", "confluent community licen[cs]e", 2, 0.95),
    ("prosperity", "prosperity public licen", "(?:the )?prosperity public licen[cs]e", 2, 0.95),
    ("hippocratic", "hippocratic licen", "hippocratic licen[cs]e", 2, 0.95),
    ("proprietary", "all rights reserved unauthori", "all rights reserved unauthori[sz]ed (?:copying|reproduction|use)", 2, 0.9),
    ("proprietary", "confidential and proprietary", "(?:this (?:file|software) is )?(?:strictly )?confidential and proprietary", 3, 0.7),
    ("proprietary", "end user license agreement", "end user license agreement", 3, 0.8),
    ("proprietary", "may not be reproduced", "may not be reproduced(?: or transmitted| distributed)? in any form", 3, 0.8),
    ("proprietary", "for personal non commercial use only", "for personal non commercial use only", 3, 0.7),
    # Warranty disclaimers: a licence text, but not which
    ("disclaimer", "without warranty of any kind", "(?:the software is provided as is )?without warranty of any kind express or implied", 4, 0.4),
    ("disclaimer", "merchantability", "(?:implied )?warrant(?:y|ies) of merchantability(?: and| or)? fitness for a particular purpose", 4, 0.4),
    ("disclaimer", "in no event shall the authors", "in no event shall the authors? or copyright holders? be liable", 4, 0.4),
    ("disclaimer", "in the hope that it will be useful", "distributed in the hope that it will be useful but without any warranty", 4, 0.5),
    ("licensed", "spdx license identifier", "spdx license identifier", 4, 0.3),
    ("licensed", "see the license file", "see the license file(?: for details| for more information)?", 4, 0.3),
]
