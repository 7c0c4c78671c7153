"""Signature rules of operator 5.

Texts are matched in normal form: ASCII lower case, words (letters, digits and everything above ASCII) joined by one
space, with one space at either end. Patterns are written for that form; each starts and ends at a word
boundary by itself. A rule is (label, priority, confidence, keyword, pattern): the pattern is only run where the
keyword, a piece of plain text that every match holds, occurs.
"""

from __future__ import annotations

# fixed values: the base phrases and their labels
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# fixed values: wordings of the licences themselves
WORDINGS = [
    ("mit", 90, 0.95, "hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 60, 0.6, "merge publish distribute", r"use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", 50, 0.5, "released under", r"released under (the )?mit"),
    ("x11", 91, 0.9, "x consortium", r"except as contained in this notice the names? of the x consortium shall not be used"),
    ("isc", 90, 0.95, "with or without fee is hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", 95, 0.95, "apache license", r"licensed under the apache license version 2 0"),
    ("apache-2.0", 90, 0.9, "apache org licenses", r"(http|https)? ?(www )?apache org licenses license 2 0"),
    ("apache-2.0", 88, 0.9, "apache license", r"apache license version 2 0( january 2004)?"),
    ("apache-1.1", 88, 0.9, "apache", r"apache (software )?license version 1 1"),
    ("apache", 40, 0.5, "apache software foundation", r"apache software foundation"),
    ("gpl-2.0", 95, 0.95, "general public license", r"gnu general public license (as published by the free software foundation )?(either )?version 2"),
    ("gpl-3.0", 95, 0.95, "general public license", r"gnu general public license (as published by the free software foundation )?(either )?version 3"),
    ("gpl-2.0-or-later", 97, 0.95, "version 2 of the license or", r"general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", 97, 0.95, "version 3 of the license or", r"general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", 60, 0.7, "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 80, 0.8, "lesser general public", r"gnu lesser general public license"),
    ("lgpl", 80, 0.8, "library general public", r"gnu library general public license"),
    ("agpl-3.0", 85, 0.9, "affero general public", r"gnu affero general public license( version 3)?"),
    ("gpl", 45, 0.5, "gnu org licenses", r"gnu org licenses( old licenses)?( gpl)?"),
    ("bsd", 85, 0.85, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 92, 0.9, "endorse or promote", r"neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 93, 0.9, "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", 40, 0.5, "bsd license", r"bsd license"),
    ("mpl-2.0", 92, 0.95, "mozilla public", r"subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", 92, 0.95, "mozilla public", r"subject to the mozilla public license version 1 1"),
    ("mpl", 60, 0.7, "mozilla public license", r"mozilla public license"),
    ("epl-1.0", 90, 0.9, "eclipse public license", r"eclipse public license v 1 0"),
    ("epl-2.0", 90, 0.9, "eclipse public license", r"eclipse public license v 2 0"),
    ("epl", 60, 0.7, "eclipse public license", r"eclipse public license"),
    ("cddl", 60, 0.7, "common development and distribution", r"common development and distribution license"),
    ("cpl-1.0", 60, 0.7, "common public license", r"common public license"),
    ("bsl-1.0", 90, 0.9, "boost software license", r"boost software license version 1 0"),
    ("zlib", 85, 0.9, "without any express or implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", 90, 0.95, "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", 50, 0.6, "public domain", r"(released|placed|dedicated) (in|into|to) the public domain"),
    ("wtfpl", 90, 0.95, "fuck you want", r"do what the fuck you want to"),
    ("cc0-1.0", 85, 0.9, "publicdomain zero", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", 70, 0.7, "creativecommons org licenses by", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", 72, 0.75, "creativecommons org licenses by sa", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", 72, 0.75, "creativecommons org licenses by nc", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", 72, 0.75, "creativecommons org licenses by nd", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", 74, 0.8, "creativecommons org licenses by nc sa", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", 74, 0.8, "creativecommons org licenses by nc nd", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("creative-commons", 40, 0.5, "creative commons", r"creative commons (attribution )?license"),
    ("ofl-1.1", 85, 0.9, "sil open font", r"sil open font license( version 1 1)?"),
    ("gfdl", 80, 0.8, "free documentation license", r"gnu free documentation license"),
    ("artistic", 60, 0.7, "artistic license", r"artistic license"),
    ("perl", 70, 0.8, "same terms as perl", r"under the same terms as perl( itself)?"),
    ("openssl", 90, 0.9, "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("postgresql", 90, 0.9, "university of california", r"in no event shall the university of california be liable"),
    ("python-2.0", 85, 0.9, "python software foundation", r"python software foundation license( version 2)?"),
    ("ms-pl", 85, 0.9, "microsoft public license", r"microsoft public license"),
    ("eupl", 80, 0.8, "european union public", r"european union public licen[cs]e"),
    ("busl-1.1", 85, 0.9, "business source license", r"business source license( version)?( 1 1)?"),
    ("sspl-1.0", 85, 0.9, "server side public license", r"server side public license( version)?( 1)?"),
    ("proprietary", 50, 0.6, "all rights reserved", r"all rights reserved"),
    ("proprietary", 60, 0.7, "confidential", r"proprietary and confidential"),
    ("commercial", 50, 0.6, "commercial license", r"commercial license"),
    ("no-warranty", 20, 0.2, "without warrant", r"without warrant(y|ies) of any kind"),
    ("dual", 55, 0.6, "dual licensed", r"dual licensed under"),
]

# fixed values: how texts name the licence that they are under
NAMES = [
    ("mit", 70, 0.85, "licensed under", r"licensed under (the |an? )?(mit|expat)( x11)?( open source)?( licen[cs]e)?"),
    ("mit", 94, 0.98, "spdx license identifier mit", r"spdx license identifier mit"),
    ("mit", 68, 0.8, "expat", r"expat licen[cs]e"),
    ("mit", 68, 0.8, "mit x11", r"mit x11( style)? licen[cs]e"),
    ("mit", 66, 0.7, "mit style license", r"mit style license"),
    ("mit", 64, 0.7, "the mit license mit", r"the mit license mit"),
    ("mit-0", 95, 0.98, "spdx license identifier mit 0", r"spdx license identifier mit 0"),
    ("mit-0", 86, 0.9, "mit no attribution", r"mit no attribution( license)?"),
    ("apache-2.0", 96, 0.98, "spdx license identifier apache 2 0", r"spdx license identifier apache 2 0"),
    ("apache-2.0", 72, 0.85, "apache", r"(licensed|released|available|distributed) under (the )?apache (version )?2( 0)?( license)?"),
    ("apache-2.0", 70, 0.8, "asl 2 0", r"asl 2 0"),
    ("apache-2.0", 71, 0.8, "apache license 2 0", r"apache license 2 0"),
    ("apache-1.0", 86, 0.9, "apache", r"apache (software )?license version 1 0"),
    ("apache-1.1", 95, 0.98, "spdx license identifier apache 1 1", r"spdx license identifier apache 1 1"),
    ("gpl-1.0", 94, 0.98, "spdx license identifier gpl 1 0", r"spdx license identifier gpl 1 0( only| or later)?"),
    ("gpl-2.0", 94, 0.98, "spdx license identifier gpl 2 0", r"spdx license identifier gpl 2 0( only)?"),
    ("gpl-2.0-or-later", 97, 0.98, "spdx license identifier gpl 2 0 or later", r"spdx license identifier gpl 2 0 or later"),
    ("gpl-3.0", 94, 0.98, "spdx license identifier gpl 3 0", r"spdx license identifier gpl 3 0( only)?"),
    ("gpl-3.0-or-later", 97, 0.98, "spdx license identifier gpl 3 0 or later", r"spdx license identifier gpl 3 0 or later"),
    ("gpl-1.0", 75, 0.8, "gpl", r"(gnu )?gpl ?v(ersion )?1( 0)?"),
    ("gpl-2.0", 75, 0.8, "gpl", r"(gnu )?gpl ?(v ?|version )2( 0)?"),
    ("gpl-3.0", 75, 0.8, "gpl", r"(gnu )?gpl ?(v ?|version )3( 0)?"),
    ("gpl-2.0", 74, 0.75, "gplv2", r"gplv2"),
    ("gpl-3.0", 74, 0.75, "gplv3", r"gplv3"),
    ("gpl-2.0-or-later", 78, 0.8, "gpl", r"gpl ?v2 or (any )?later"),
    ("gpl-3.0-or-later", 78, 0.8, "gpl", r"gpl ?v3 or (any )?later"),
    ("gpl", 55, 0.6, "licensed under the gpl", r"licensed under the gpl"),
    ("gpl", 55, 0.6, "terms of the gnu gpl", r"terms of the gnu gpl"),
    ("gpl", 50, 0.6, "copy of the gnu general public license", r"you should have received a copy of the gnu general public license"),
    ("gpl-classpath-exception", 92, 0.9, "classpath exception", r"(with )?(the )?classpath exception"),
    ("gpl-linking-exception", 92, 0.9, "linking this library statically or dynamically", r"linking this library statically or dynamically with other modules"),
    ("gpl-bison-exception", 92, 0.9, "bison parser skeleton", r"as a special exception .{1,120} bison parser skeleton"),
    ("gcc-runtime-exception", 92, 0.9, "gcc runtime library exception", r"gcc runtime library exception( version)?( 3 1)?"),
    ("lgpl-2.0", 94, 0.98, "spdx license identifier lgpl 2 0", r"spdx license identifier lgpl 2 0( only| or later)?"),
    ("lgpl-2.1", 94, 0.98, "spdx license identifier lgpl 2 1", r"spdx license identifier lgpl 2 1( only| or later)?"),
    ("lgpl-3.0", 94, 0.98, "spdx license identifier lgpl 3 0", r"spdx license identifier lgpl 3 0( only| or later)?"),
    ("lgpl-2.0", 85, 0.9, "library general public", r"gnu library general public license version 2"),
    ("lgpl-2.1", 85, 0.9, "lesser general public", r"gnu lesser general public license (as published by the free software foundation )?(either )?version 2 1"),
    ("lgpl-3.0", 85, 0.9, "lesser general public", r"gnu lesser general public license (as published by the free software foundation )?(either )?version 3"),
    ("lgpl-2.1", 75, 0.8, "lgpl", r"lgpl ?(v ?|version )2 1"),
    ("lgpl-3.0", 75, 0.8, "lgpl", r"lgpl ?(v ?|version )3( 0)?"),
    ("lgpl", 55, 0.6, "licensed under the lgpl", r"licensed under the (gnu )?lgpl"),
    ("agpl-3.0", 94, 0.98, "spdx license identifier agpl 3 0", r"spdx license identifier agpl 3 0( only| or later)?"),
    ("agpl-3.0", 75, 0.8, "agpl", r"agpl ?(v ?|version )3( 0)?"),
    ("agpl-1.0", 85, 0.9, "affero general public license version 1", r"affero general public license version 1"),
    ("bsd-1-clause", 94, 0.98, "spdx license identifier bsd 1 clause", r"spdx license identifier bsd 1 clause"),
    ("bsd-2-clause", 94, 0.98, "spdx license identifier bsd 2 clause", r"spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", 94, 0.98, "spdx license identifier bsd 3 clause", r"spdx license identifier bsd 3 clause"),
    ("bsd-4-clause", 94, 0.98, "spdx license identifier bsd 4 clause", r"spdx license identifier bsd 4 clause"),
    ("bsd-2-clause", 75, 0.85, "bsd", r"(simplified|freebsd|2 clause|two clause) bsd( licen[cs]e)?"),
    ("bsd-2-clause", 75, 0.85, "bsd 2 clause", r"bsd 2 clause( simplified)?( license)?"),
    ("bsd-3-clause", 75, 0.85, "bsd", r"(new|modified|revised|3 clause|three clause) bsd( licen[cs]e)?"),
    ("bsd-3-clause", 75, 0.85, "bsd 3 clause", r"bsd 3 clause( new| revised)?( license)?"),
    ("bsd-4-clause", 75, 0.85, "bsd", r"(original|4 clause|four clause) bsd( licen[cs]e)?"),
    ("bsd", 55, 0.6, "bsd style license", r"bsd style license"),
    ("bsd", 55, 0.6, "licensed under", r"licensed under (the |a )bsd( license)?"),
    ("0bsd", 94, 0.98, "0bsd", r"(spdx license identifier )?0bsd"),
    ("0bsd", 85, 0.9, "zero clause bsd", r"zero clause bsd( license)?"),
    ("isc", 94, 0.98, "spdx license identifier isc", r"spdx license identifier isc"),
    ("isc", 70, 0.8, "isc license", r"(the )?isc license"),
    ("mpl-1.0", 85, 0.9, "mozilla public license", r"mozilla public license version 1 0"),
    ("mpl-1.1", 94, 0.98, "spdx license identifier mpl 1 1", r"spdx license identifier mpl 1 1"),
    ("mpl-2.0", 94, 0.98, "spdx license identifier mpl 2 0", r"spdx license identifier mpl 2 0( no copyleft exception)?"),
    ("mpl-2.0", 85, 0.9, "mozilla public license", r"mozilla public license (version |v )2 0"),
    ("mpl-2.0", 75, 0.8, "mozilla org mpl 2 0", r"(www )?mozilla org mpl 2 0"),
    ("epl-1.0", 94, 0.98, "spdx license identifier epl 1 0", r"spdx license identifier epl 1 0"),
    ("epl-2.0", 94, 0.98, "spdx license identifier epl 2 0", r"spdx license identifier epl 2 0"),
    ("epl-1.0", 75, 0.8, "eclipse org legal epl v10", r"(www )?eclipse org legal epl v10( html)?"),
    ("epl-2.0", 75, 0.8, "eclipse org legal epl 2 0", r"(www )?eclipse org legal epl 2 0"),
    ("edl-1.0", 85, 0.9, "eclipse distribution license", r"eclipse distribution license( v)?( 1 0)?"),
    ("cddl-1.0", 85, 0.9, "cddl", r"(spdx license identifier )?cddl (version )?1 0"),
    ("cddl-1.1", 85, 0.9, "cddl", r"(spdx license identifier )?cddl (version )?1 1"),
    ("cpl-1.0", 80, 0.85, "common public license", r"common public license (version |v )1 0"),
    ("ipl-1.0", 80, 0.85, "ibm public license", r"ibm public license( version 1 0)?"),
    ("lpl-1.02", 80, 0.85, "lucent public license", r"lucent public license( version 1 02)?"),
    ("artistic-1.0", 80, 0.85, "artistic license 1 0", r"artistic license 1 0"),
    ("artistic-2.0", 80, 0.85, "artistic license 2 0", r"(the )?artistic license 2 0"),
    ("artistic-1.0-perl", 80, 0.85, "perl artistic license", r"perl artistic license"),
    ("zlib", 94, 0.98, "spdx license identifier zlib", r"spdx license identifier zlib"),
    ("zlib", 70, 0.8, "zlib license", r"zlib license"),
    ("zlib", 70, 0.8, "zlib libpng license", r"zlib libpng license"),
    ("libpng", 75, 0.85, "png reference library", r"png reference library( license)?"),
    ("bsl-1.0", 94, 0.98, "spdx license identifier bsl 1 0", r"spdx license identifier bsl 1 0"),
    ("bsl-1.0", 75, 0.85, "boost org license 1 0", r"(www )?boost org license 1 0( txt)?"),
    ("busl-1.1", 94, 0.98, "spdx license identifier busl 1 1", r"spdx license identifier busl 1 1"),
    ("unlicense", 94, 0.98, "spdx license identifier unlicense", r"spdx license identifier unlicense"),
    ("unlicense", 70, 0.8, "unlicense org", r"unlicense org"),
    ("wtfpl", 94, 0.98, "wtfpl", r"(spdx license identifier )?wtfpl( version 2)?"),
    ("cc0-1.0", 94, 0.98, "spdx license identifier cc0 1 0", r"spdx license identifier cc0 1 0"),
    ("cc0-1.0", 80, 0.85, "cc0", r"cc0 1 0( universal)?( public domain dedication)?"),
    ("cc-by-2.0", 80, 0.85, "attribution 2 0", r"creative commons attribution 2 0( generic| unported)?( licen[cs]e)?"),
    ("cc-by-2.5", 80, 0.85, "attribution 2 5", r"creative commons attribution 2 5( generic| unported)?( licen[cs]e)?"),
    ("cc-by-3.0", 80, 0.85, "attribution 3 0", r"creative commons attribution 3 0( generic| unported)?( licen[cs]e)?"),
    ("cc-by-4.0", 80, 0.85, "attribution 4 0", r"creative commons attribution 4 0( international)?( licen[cs]e)?"),
    ("cc-by-sa-3.0", 82, 0.85, "attribution share", r"creative commons attribution share ?alike 3 0( unported)?( licen[cs]e)?"),
    ("cc-by-sa-4.0", 82, 0.85, "attribution share", r"creative commons attribution share ?alike 4 0( international)?( licen[cs]e)?"),
    ("cc-by-nc-4.0", 82, 0.85, "attribution non", r"creative commons attribution non ?commercial 4 0( international)?( licen[cs]e)?"),
    ("cc-by-nd-4.0", 82, 0.85, "attribution no", r"creative commons attribution no ?derivatives 4 0( international)?( licen[cs]e)?"),
    ("cc-by-nc-sa-4.0", 84, 0.85, "attribution non", r"creative commons attribution non ?commercial share ?alike 4 0( international)?( licen[cs]e)?"),
    ("cc-by-nc-nd-4.0", 84, 0.85, "attribution non", r"creative commons attribution non ?commercial no ?derivatives 4 0( international)?( licen[cs]e)?"),
    ("cc-by-4.0", 78, 0.8, "cc by 4 0", r"cc by 4 0"),
    ("cc-by-3.0", 78, 0.8, "cc by 3 0", r"cc by 3 0"),
    ("cc-by-sa-4.0", 78, 0.8, "cc by sa 4 0", r"cc by sa 4 0"),
    ("cc-by-sa-3.0", 78, 0.8, "cc by sa 3 0", r"cc by sa 3 0"),
    ("cc-by-nc-4.0", 78, 0.8, "cc by nc 4 0", r"cc by nc 4 0"),
    ("cc-by-nd-4.0", 78, 0.8, "cc by nd 4 0", r"cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", 78, 0.8, "cc by nc sa 4 0", r"cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", 78, 0.8, "cc by nc nd 4 0", r"cc by nc nd 4 0"),
    ("pddl-1.0", 80, 0.85, "public domain dedication", r"(open data commons )?public domain dedication (and|amp) licen[cs]e"),
    ("odbl-1.0", 80, 0.85, "open database", r"open database licen[cs]e( odbl)?( v1 0)?"),
    ("odc-by-1.0", 80, 0.85, "open data commons attribution", r"open data commons attribution licen[cs]e( v1 0)?"),
    ("ofl-1.1", 94, 0.98, "spdx license identifier ofl 1 1", r"spdx license identifier ofl 1 1"),
    ("ofl-1.1", 75, 0.8, "scripts sil org ofl", r"scripts sil org ofl"),
    ("gfdl-1.2", 85, 0.9, "free documentation license", r"gnu free documentation license version 1 2"),
    ("gfdl-1.3", 85, 0.9, "free documentation license", r"gnu free documentation license version 1 3"),
    ("python-2.0", 94, 0.98, "psf 2 0", r"(spdx license identifier )?psf 2 0"),
    ("python-2.0", 94, 0.98, "spdx license identifier python 2 0", r"spdx license identifier python 2 0"),
    ("php-3.0", 80, 0.85, "php license", r"php license version 3 0"),
    ("php-3.01", 80, 0.85, "php license", r"(subject to version 3 01 of the php license|php license version 3 01)"),
    ("ruby", 75, 0.8, "ruby", r"(same terms as ruby|ruby s license|ruby license)"),
    ("openssl", 80, 0.85, "openssl", r"(dual )?openssl (and ssleay )?license"),
    ("ssleay", 85, 0.9, "eric young", r"cryptographic software written by eric young"),
    ("curl", 80, 0.85, "curl license", r"(the )?curl license"),
    ("postgresql", 80, 0.85, "postgresql licen", r"postgresql licen[cs]e"),
    ("unicode-3.0", 80, 0.85, "unicode license v3", r"unicode license v3"),
    ("unicode-dfs", 80, 0.85, "unicode inc license agreement", r"unicode inc license agreement data files and software"),
    ("icu", 80, 0.85, "icu license", r"icu license( icu 1 8 1 and later)?"),
    ("w3c", 80, 0.85, "w3c", r"w3c software (notice and )?(and document )?licen[cs]e"),
    ("x11", 75, 0.8, "x11 license", r"(the )?x11 license"),
    ("ntp", 80, 0.85, "network time protocol", r"network time protocol (ntp )?license"),
    ("tcl", 80, 0.85, "tcl", r"tcl (tk )?license"),
    ("vim", 80, 0.85, "vim license", r"vim license"),
    ("sleepycat", 80, 0.85, "sleepycat", r"sleepycat (software )?(product )?license"),
    ("qpl-1.0", 80, 0.85, "q public license", r"q public license( version 1 0)?"),
    ("osl-3.0", 80, 0.85, "open software license", r"open software license( version| v)?( 3 0)?"),
    ("afl-3.0", 80, 0.85, "academic free license", r"academic free license( version| v)?( 3 0)?"),
    ("ecl-2.0", 80, 0.85, "educational community license", r"educational community license( version 2 0)?"),
    ("eupl-1.1", 85, 0.9, "eupl", r"eupl ?(v ?|version )?1 1"),
    ("eupl-1.2", 85, 0.9, "eupl", r"eupl ?(v ?|version )?1 2"),
    ("ms-rl", 85, 0.9, "microsoft reciprocal license", r"microsoft reciprocal license"),
    ("apsl-2.0", 85, 0.9, "apple public source license", r"apple public source license( version 2 0)?"),
    ("nasa-1.3", 85, 0.9, "nasa open source agreement", r"nasa open source agreement( version 1 3)?"),
    ("ncsa", 85, 0.9, "ncsa", r"(university of illinois )?ncsa open source license"),
    ("upl-1.0", 85, 0.9, "universal permissive license", r"universal permissive license( v)?( 1 0)?"),
    ("mulanpsl-2.0", 85, 0.9, "mulan", r"mulan (psl|permissive software license) ?v?2"),
    ("cecill-2.1", 85, 0.9, "cecill", r"cecill (free software )?(license )?(agreement )?(version )?2 1"),
    ("cecill", 60, 0.7, "cecill", r"cecill( free software)? license"),
    ("elastic-2.0", 85, 0.9, "elastic license", r"elastic license( version)?( 2 0)?"),
    ("polyform-nc-1.0", 85, 0.9, "polyform noncommercial", r"polyform noncommercial license( 1 0 0)?"),
    ("polyform-shield-1.0", 85, 0.9, "polyform shield", r"polyform shield license( 1 0 0)?"),
    ("commons-clause", 85, 0.9, "commons clause", r"commons clause license condition( v1 0)?"),
    ("llama-community", 85, 0.9, "community license agreement", r"llama [23]( [0-9])? community license agreement"),
    ("openrail", 85, 0.9, "openrail", r"(creativeml |bigscience )?openrail( m)?( license)?"),
    ("beerware", 85, 0.9, "beer", r"(beerware license|you can buy me a beer in return)"),
    ("json", 85, 0.9, "used for good not evil", r"the software shall be used for good not evil"),
    ("fair", 80, 0.85, "usage of the works is permitted", r"usage of the works is permitted provided that this instrument is retained"),
    ("bzip2", 80, 0.85, "bzip2 and libbzip2", r"bzip2 and libbzip2 license"),
    ("ijg", 80, 0.85, "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", 80, 0.85, "freetype project license", r"freetype project license"),
    ("imagemagick", 80, 0.85, "imagemagick license", r"imagemagick license"),
    ("latex-1.3c", 80, 0.85, "latex project public license", r"latex project public license( version 1 3c?)?"),
    ("ogl-3.0", 80, 0.85, "open government licence", r"open government licence( v3 0)?"),
    ("cern-ohl", 80, 0.85, "cern open hardware", r"cern open hardware licence( version 2)?( permissive| weakly reciprocal| strongly reciprocal)?"),
    ("blueoak-1.0", 80, 0.85, "blue oak model license", r"blue oak model license( 1 0 0)?"),
    ("proprietary", 55, 0.6, "unpublished proprietary", r"unpublished proprietary source code"),
    ("proprietary", 55, 0.6, "may not be reproduced", r"may not be reproduced (or distributed )?without (the )?(prior |express )?(written )?permission"),
    ("no-license", 45, 0.5, "no license is granted", r"no license is granted"),
    ("see-license", 30, 0.3, "license", r"see (the )?(accompanying )?license (file )?for (details|more information|licensing information)"),
    ("see-license", 30, 0.3, "license file in the root", r"(found in|see) the license file in the root"),
]


def rules() -> list[tuple[str, int, float, str, str]]:
    """All rules, in order: base phrases first, then wordings, then names."""
    return [(label, 100, 0.9, phrase, phrase) for label, phrase in BASE] + WORDINGS + NAMES
