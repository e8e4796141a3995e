"""License scan: ordered signature rules over normalised words.

A text becomes its lower-case words joined by single spaces, so rules need no white-space variants. Words
gate rules: of some three hundred rules, written out one by one, only those are tried whose needed words, derived from the rule's own
expression, occur in the text. Each match has
an interval; a match that lies inside one of a rule of higher priority, or inside a longer one of equal priority, is
suppressed. Equal intervals of equal priority both stay. All of it is column functions; the rules are one constant.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.spans import match_spans, plus, running
from flowlens.llm.texts import ascii_lower, whole
from flowlens.plans.shared import let

#: Everything that is no word character: ASCII but for digits and letters. Characters beyond ASCII are words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Signatures, one a line: label, priority, score, regular expression over normalised words. By priority: 0 to 1 hints,
#: 2 a name, 3 to 4 a name with version or address, 5 to 6 sentences of notices, 7 to 8 identifiers.
SIGNATURES = """
mit 6 0.95 permission is hereby granted free of charge to any person obtaining a copy
mit 6 0.95 the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit 5 0.9 the software is provided as is without warranty of any kind express or implied
mit 2 0.9 mit licen[cs]e
mit 2 0.9 mit style licen[cs]e
mit 2 0.9 mit x11 licen[cs]e
mit 2 0.85 mit x11
mit 2 0.85 mit licen[cs]ed
mit 2 0.85 mit licen[cs]es
mit 2 0.9 expat licen[cs]e
mit 3 0.95 (?:licensed|released|distributed|available|published) under(?: the)?(?: terms of the)? mit(?: licen[cs]e)?
mit 3 0.95 opensource org licenses mit
mit 1 0.6 licen[cs]e mit
x11 2 0.9 x11 licen[cs]e
x11 6 0.95 except as contained in this notice the name of the x consortium shall not be used
mit-0 2 0.9 mit no attribution
apache 6 0.95 licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e
apache 6 0.95 you may obtain a copy of the licen[cs]e at (?:http|https) www apache org licenses license 2 0
apache 5 0.95 apache licen[cs]e version 2 0 january 2004
apache 4 0.97 apache(?: software)?(?: licen[cs]e)?(?: version)? (?:v2|2|v1|1)(?: 0| 1)?
apache 2 0.9 apache licen[cs]e
apache 2 0.85 apache licen[cs]ed
apache 1 0.6 licen[cs]e apache
apache 2 0.9 apache software licen[cs]e
apache 3 0.95 (?:licensed|released|distributed|available|published) under(?: the)?(?: terms of the)? apache(?: software)?(?: licen[cs]e)?
apache 6 0.95 this product includes software developed by the apache software foundation
apache 3 0.95 opensource org licenses apache 2 0
gpl 6 0.95 you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl 6 0.95 you should have received a copy of the gnu general public licen[cs]e
gpl 6 0.95 see the gnu general public licen[cs]e for more details
gpl 5 0.95 gnu general public licen[cs]e version 2 june 1991
gpl 5 0.95 gnu general public licen[cs]e version 3 29 june 2007
gpl 5 0.97 (?:gnu )?general public licen[cs]e(?: version)? (?:v1|v2|v3|1|2|3)(?: 0)?(?: or(?: any)? later(?: version)?)?
gpl 2 0.9 (?:gnu )?general public licen[cs]e
gpl 3 0.9 (?:gnu )?gpl (?:v2|v3|2|3)(?: 0)?(?: only| or later)?
gpl 3 0.9 (?:gplv2|gplv3)(?: only| or later)?
gpl 2 0.85 (?:gnu )?gpl licen[cs]es?
gpl 3 0.9 (?:licensed|released|distributed|available|published) under(?: the)?(?: terms of the)? (?:gnu )?gpl
gpl 2 0.85 gnu gpl
gpl 4 0.95 www gnu org licenses gpl
gpl-linking-exception 5 0.9 gives you permission to link this (?:library|program) with independent modules
gpl-classpath-exception 5 0.9 classpath exception
gpl-gcc-exception 5 0.9 gcc runtime library exception
lgpl 6 0.95 you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
lgpl 6 0.95 you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
lgpl 6 0.95 see the gnu (?:lesser|library) general public licen[cs]e for more details
lgpl 5 0.97 (?:gnu )?(?:lesser|library) general public licen[cs]e(?: version)? (?:v2|v3|2|3)(?: 0| 1)?(?: or(?: any)? later(?: version)?)?
lgpl 2 0.9 (?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl 3 0.9 (?:gnu )?lgpl (?:v2|v3|2|3)(?: 0| 1)?(?: only| or later)?
lgpl 3 0.9 (?:lgplv2|lgplv3)(?: only| or later)?
lgpl 2 0.85 (?:gnu )?lgpl licen[cs]es?
lgpl 3 0.9 (?:licensed|released|distributed|available|published) under(?: the)?(?: terms of the)? (?:gnu )?lgpl
lgpl 2 0.85 gnu lgpl
lgpl 1 0.6 licen[cs]e lgpl
lgpl 4 0.95 www gnu org licenses lgpl
agpl 6 0.95 you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
agpl 6 0.95 you should have received a copy of the gnu affero general public licen[cs]e
agpl 5 0.97 (?:gnu )?affero general public licen[cs]e(?: version)? (?:v1|v3|1|3)(?: 0)?(?: or(?: any)? later(?: version)?)?
agpl 2 0.9 (?:gnu )?affero general public licen[cs]e
agpl 3 0.9 (?:gnu )?agpl (?:v3|3)(?: 0)?(?: only| or later)?
agpl 3 0.9 agplv3(?: only| or later)?
agpl 2 0.85 (?:gnu )?agpl licen[cs]es?
agpl 3 0.9 (?:licensed|released|distributed|available|published) under(?: the)?(?: terms of the)? (?:gnu )?agpl
agpl 2 0.85 gnu agpl
agpl 1 0.6 licen[cs]e agpl
agpl 4 0.95 www gnu org licenses agpl
gfdl 6 0.95 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl 4 0.97 (?:gnu )?free documentation licen[cs]e version 1 (?:1|2|3)
gfdl 2 0.9 (?:gnu )?free documentation licen[cs]e
gfdl 2 0.8 gfdl
bsd 6 0.9 redistribution and use in source and binary forms with or without modification are permitted
bsd 5 0.9 redistribution and use in source and binary forms
bsd 5 0.85 redistributions of source code must retain the above copyright notice
bsd 5 0.85 redistributions in binary form must reproduce the above copyright notice
bsd 5 0.8 this software is provided by the (?:copyright holders|authors|regents) and contributors as is
bsd 1 0.85 bsd licen[cs]es?
bsd 1 0.6 licen[cs]e bsd
bsd 1 0.8 bsd style licen[cs]e
bsd 1 0.85 berkeley software distribution licen[cs]e
bsd 3 0.9 (?:licensed|released|distributed|available|published) under(?: the)?(?: terms of the)? bsd(?: licen[cs]e)?
bsd-3-clause 6 0.9 may(?: not)? be used to endorse or promote products
bsd-3-clause 4 0.9 (?:licensed|released|distributed|available|published) under(?: the)?(?: terms of the)? (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-3-clause 2 0.9 bsd 3 clause(?: licen[cs]e)?
bsd-3-clause 2 0.9 3 clause bsd(?: licen[cs]e)?
bsd-3-clause 2 0.9 three clause bsd(?: licen[cs]e)?
bsd-3-clause 2 0.9 (?:new|modified|revised) bsd(?: licen[cs]e)?
bsd-2-clause 4 0.9 (?:licensed|released|distributed|available|published) under(?: the)?(?: terms of the)? (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
bsd-2-clause 2 0.9 bsd 2 clause(?: licen[cs]e)?
bsd-2-clause 2 0.9 2 clause bsd(?: licen[cs]e)?
bsd-2-clause 2 0.9 two clause bsd(?: licen[cs]e)?
bsd-2-clause 2 0.9 simplified bsd(?: licen[cs]e)?
bsd-2-clause 2 0.9 freebsd licen[cs]e
bsd-4-clause 6 0.9 all advertising materials mentioning features or use of this software
bsd-4-clause 2 0.9 bsd 4 clause(?: licen[cs]e)?
bsd-4-clause 2 0.9 4 clause bsd(?: licen[cs]e)?
bsd-4-clause 2 0.9 original bsd licen[cs]e
0bsd 2 0.9 zero clause bsd(?: licen[cs]e)?
0bsd 2 0.9 bsd zero clause(?: licen[cs]e)?
0bsd 2 0.9 0bsd
isc 6 0.95 permission to use copy modify and or distribute this software for any purpose with or without fee
isc 6 0.95 permission to use copy modify and distribute this software for any purpose with or without fee
isc 2 0.9 isc licen[cs]e
isc 2 0.85 isc licen[cs]ed
isc 1 0.6 licen[cs]e isc
isc 3 0.9 (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)? isc(?: licen[cs]e)?
mpl 6 0.95 this source code form is subject to the terms of the mozilla public licen[cs]e
mpl 6 0.95 the contents of this file are subject to the mozilla public licen[cs]e
mpl 6 0.95 if a copy of the mpl was not distributed with this file
mpl 4 0.97 mozilla public licen[cs]e(?: version)? (?:v1|v2|1|2)(?: 0| 1)?
mpl 2 0.9 mozilla public licen[cs]e
mpl 1 0.6 licen[cs]e mpl
mpl 3 0.9 mpl (?:v1|v2|1|2)(?: 0| 1)?
epl 6 0.95 are made available under the terms of the eclipse public licen[cs]e
epl 4 0.97 eclipse public licen[cs]e(?: version)? (?:v1|v2|v10|v20|1|2)(?: 0)?
epl 2 0.9 eclipse public licen[cs]e
epl 3 0.85 epl (?:v1|v2|1|2)(?: 0)?
edl 2 0.9 eclipse distribution licen[cs]e(?: version| v)?(?: 1)?(?: 0)?
cddl 6 0.95 the contents of this file are subject to the terms of the common development and distribution licen[cs]e
cddl 2 0.9 common development and distribution licen[cs]e(?: version)?(?: 1)?(?: 0| 1)?
cddl 2 0.85 cddl
cpl 2 0.9 common public licen[cs]e(?: version)?(?: 1)?(?: 0)?
cpal 2 0.9 common public attribution licen[cs]e
ipl 2 0.9 ibm public licen[cs]e(?: version)?(?: 1)?(?: 0)?
eupl 6 0.95 licensed under the eupl
eupl 2 0.9 european union public licen[cs]e(?: version| v)?(?: 1)?(?: 0| 1| 2)?
eupl 2 0.85 eupl
artistic 6 0.95 under the same (?:terms|license|licence) as perl(?: itself)?
artistic 4 0.97 artistic licen[cs]e(?: version)? (?:1|2)(?: 0)?
artistic 2 0.9 (?:perl )?artistic licen[cs]e
bsl 6 0.95 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
bsl 2 0.9 boost software licen[cs]e(?: version)?(?: 1)?(?: 0)?
busl 6 0.95 the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
busl 2 0.9 business source licen[cs]e(?: version)?(?: 1)?(?: 0| 1)?
sspl 2 0.9 server side public licen[cs]e(?: version| v1)?(?: 1)?
sspl 2 0.85 sspl
elastic 2 0.9 elastic licen[cs]e(?: version)?(?: 1| 2| v2)?(?: 0)?
polyform 2 0.9 polyform (?:noncommercial|shield|strict|perimeter|internal use|small business|free trial)(?: licen[cs]e)?
commons-clause 2 0.9 commons clause(?: licen[cs]e condition)?
zlib 6 0.9 the origin of this software must not be misrepresented
zlib 6 0.9 altered source versions must be plainly marked as such
zlib 6 0.9 in no event will the authors be held liable for any damages arising from the use of this software
zlib 2 0.9 zlib licen[cs]e
zlib 2 0.9 zlib libpng licen[cs]e
libpng 2 0.9 libpng licen[cs]e(?: version 2)?(?: 0)?
libpng 6 0.9 the png reference library is supplied as is
libtiff 2 0.9 libtiff licen[cs]e
ijg 6 0.95 this software is based in part on the work of the independent jpeg group
openssl 6 0.95 this product includes software developed by the openssl project for use in the openssl toolkit
openssl 2 0.9 openssl licen[cs]e
ssleay 6 0.95 this product includes cryptographic software written by eric young
ssleay 2 0.9 ssleay licen[cs]e
curl 2 0.9 curl licen[cs]e
python 6 0.95 this licen[cs]e agreement is between the python software foundation
python 2 0.9 python(?: software foundation)? licen[cs]e(?: version)?(?: 2)?(?: 0)?
python 3 0.85 psf licen[cs]e(?: version)?(?: 2)?
php 6 0.95 this product includes php software freely available from
php 2 0.9 php licen[cs]e(?: version)?(?: 3)?(?: 0| 01)?
ruby 2 0.9 ruby licen[cs]e
ruby 6 0.9 under the same terms as ruby
w3c 6 0.95 this work and any related documentation is being provided by the copyright holders under the following licen[cs]e
w3c 2 0.9 w3c(?: software)?(?: notice and)?(?: document)? licen[cs]e
odbl 6 0.95 this database is made available under the open database licen[cs]e
odbl 2 0.9 open database licen[cs]e(?: version| v1)?(?: 1)?(?: 0)?
odc-by 2 0.9 open data commons attribution licen[cs]e(?: version| v1)?(?: 1)?(?: 0)?
pddl 2 0.9 public domain dedication(?: and)? licen[cs]e(?: version| v1)?(?: 1)?(?: 0)?
ogl 6 0.9 contains public sector information licensed under the open government licen[cs]e
ogl 2 0.9 open government licen[cs]e(?: version| v1| v2| v3)?(?: 1| 2| 3)?(?: 0)?
ofl 6 0.95 this font software is licensed under the sil open font licen[cs]e
ofl 6 0.95 the font software may be sold as part of a larger software package
ofl 2 0.9 (?:sil )?open font licen[cs]e(?: version)?(?: 1)?(?: 0| 1)?
osl 6 0.95 licensed under the open software licen[cs]e version
osl 2 0.9 open software licen[cs]e(?: version| v)?(?: 1| 2| 3)?(?: 0| 1)?
afl 6 0.95 licensed under the academic free licen[cs]e version
afl 2 0.9 academic free licen[cs]e(?: version| v)?(?: 1| 2| 3)?(?: 0| 1| 2)?
ecl 2 0.9 educational community licen[cs]e(?: version)?(?: 1| 2)?(?: 0)?
efl 2 0.9 eiffel forum licen[cs]e(?: version)?(?: 1| 2)?
ms-pl 2 0.9 microsoft public licen[cs]e
ms-rl 2 0.9 microsoft reciprocal licen[cs]e
ms-pl 2 0.85 ms pl
ms-eula 5 0.8 microsoft software licen[cs]e terms
cecill 6 0.95 this software is governed by the cecill
cecill 2 0.9 cecill(?: b| c)?(?: free software)? licen[cs]e(?: version)?(?: 1| 2)?(?: 0| 1)?
mulan-psl 6 0.95 you can use this software according to the terms and conditions of the mulan psl
mulan-psl 2 0.9 mulan permissive software licen[cs]e(?: version| v)?(?: 1| 2)?
mulan-psl 2 0.85 mulan psl(?: v2)?
apsl 6 0.95 the contents of this file constitute original code as defined in and are subject to the apple public source licen[cs]e
apsl 2 0.9 apple public source licen[cs]e(?: version)?(?: 1| 2)?(?: 0| 1| 2)?
npl 2 0.9 netscape public licen[cs]e(?: version)?(?: 1)?(?: 0| 1)?
qpl 2 0.9 q public licen[cs]e(?: version)?(?: 1)?(?: 0)?
sleepycat 2 0.9 sleepycat licen[cs]e
sleepycat 6 0.9 redistributions in any form must be accompanied by information on how to obtain complete source code
postgresql 6 0.95 permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
postgresql 2 0.9 postgresql licen[cs]e
ntp 6 0.9 permission to use copy modify and distribute this software and its documentation for any purpose with or without fee
hpnd 5 0.85 permission to use copy modify and distribute this software and its documentation for any purpose
hpnd 2 0.9 historical permission notice and disclaimer
ncsa 6 0.95 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with
ncsa 2 0.9 (?:university of illinois )?ncsa(?: open source)? licen[cs]e
upl 6 0.95 subject to the condition set forth below permission is hereby granted
upl 2 0.9 universal permissive licen[cs]e(?: version| v)?(?: 1)?(?: 0)?
unicode 6 0.95 permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
unicode 2 0.9 unicode(?: inc)? licen[cs]e agreement
icu 2 0.9 icu licen[cs]e
vim 2 0.9 vim licen[cs]e
unlicense 6 0.95 free and unencumbered software released into the public domain
unlicense 6 0.9 anyone is free to copy modify publish use compile sell or distribute this software
unlicense 2 0.9 (?:the )?unlicense
wtfpl 6 0.95 do what the fuck you want to public licen[cs]e
wtfpl 6 0.95 you just do what the fuck you want to
wtfpl 2 0.9 wtfpl(?: version 2)?
beerware 6 0.95 if we meet some day and you think this stuff is worth it you can buy me a beer
beerware 2 0.9 (?:beerware|beer ware) licen[cs]e
json 6 0.95 the software shall be used for good not evil
hippocratic 2 0.9 hippocratic licen[cs]e(?: version)?(?: 2| 3)?(?: 0| 1)?
anti-996 2 0.9 anti 996 licen[cs]e
openrail 2 0.9 (?:creativeml |bigscience )?(?:openrail|open rail)(?: m| s)?(?: licen[cs]e)?
rail 5 0.9 responsible ai licen[cs]e
llama 6 0.95 llama(?: 2| 3| 3 1| 3 2)? is licensed under the llama
llama 2 0.9 llama(?: 2| 3| 3 1| 3 2)?(?: community)? licen[cs]e
gemma 2 0.9 gemma terms of use
cc0 6 0.95 has waived all copyright and related or neighboring rights to this work
cc0 2 0.9 cc0(?: 1 0)?(?: universal)?(?: licen[cs]e)?
cc0 4 0.95 creativecommons org publicdomain zero 1 0
public-domain 4 0.95 creativecommons org publicdomain mark 1 0
cc-by 4 0.97 cc by (?:1|2|3|4) (?:0|5)
cc-by-sa 4 0.97 cc by sa (?:1|2|3|4) (?:0|5)
cc-by-nd 4 0.97 cc by nd (?:1|2|3|4) (?:0|5)
cc-by-nc 4 0.97 cc by nc (?:1|2|3|4) (?:0|5)
cc-by-nc-sa 4 0.97 cc by nc sa (?:1|2|3|4) (?:0|5)
cc-by-nc-nd 4 0.97 cc by nc nd (?:1|2|3|4) (?:0|5)
cc-by 1 0.85 cc by(?: licen[cs]e)?
cc-by-sa 2 0.9 cc by sa(?: licen[cs]e)?
cc-by-nd 2 0.9 cc by nd(?: licen[cs]e)?
cc-by-nc 2 0.9 cc by nc(?: licen[cs]e)?
cc-by-nc-sa 3 0.9 cc by nc sa(?: licen[cs]e)?
cc-by-nc-nd 3 0.9 cc by nc nd(?: licen[cs]e)?
cc-by 4 0.95 creativecommons org licenses by(?: 1 0| 2 0| 2 5| 3 0| 4 0)?
cc-by-sa 5 0.95 creativecommons org licenses by sa(?: 1 0| 2 0| 2 5| 3 0| 4 0)?
cc-by-nd 5 0.95 creativecommons org licenses by nd(?: 1 0| 2 0| 2 5| 3 0| 4 0)?
cc-by-nc 5 0.95 creativecommons org licenses by nc(?: 1 0| 2 0| 2 5| 3 0| 4 0)?
cc-by-nc-sa 6 0.95 creativecommons org licenses by nc sa(?: 1 0| 2 0| 2 5| 3 0| 4 0)?
cc-by-nc-nd 6 0.95 creativecommons org licenses by nc nd(?: 1 0| 2 0| 2 5| 3 0| 4 0)?
cc-by 2 0.95 creative commons attribution(?: 1 0| 2 0| 2 5| 3 0| 4 0)?(?: international| unported)?(?: licen[cs]e)?
cc-by-sa 3 0.95 creative commons attribution (?:sharealike|share alike)(?: 1 0| 2 0| 2 5| 3 0| 4 0)?(?: international| unported)?(?: licen[cs]e)?
cc-by-nd 3 0.95 creative commons attribution (?:noderivatives|noderivs|no derivatives|no derivs)(?: 1 0| 2 0| 2 5| 3 0| 4 0)?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc 3 0.95 creative commons attribution (?:noncommercial|non commercial)(?: 1 0| 2 0| 2 5| 3 0| 4 0)?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc-sa 4 0.95 creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike)(?: 1 0| 2 0| 2 5| 3 0| 4 0)?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc-nd 4 0.95 creative commons attribution (?:noncommercial|non commercial) (?:noderivatives|noderivs|no derivatives|no derivs)(?: 1 0| 2 0| 2 5| 3 0| 4 0)?(?: international| unported)?(?: licen[cs]e)?
cc 1 0.6 creative commons licen[cs]e
cc 1 0.6 licensed under (?:a )?creative commons
cc 1 0.5 some rights reserved
public-domain 5 0.8 (?:is|are|was|were|placed|dedicated|released) (?:in|to|into) the public domain
public-domain 5 0.8 this (?:file|code|work|software) is public domain
public-domain 1 0.5 public domain
public-domain 5 0.8 no copyright is claimed
us-government 5 0.85 work of the united states government
us-government 5 0.85 not subject to copyright protection in the united states
proprietary 1 0.4 all rights reserved
proprietary 3 0.7 proprietary (?:and confidential|licen[cs]e)
proprietary 3 0.7 confidential and proprietary
proprietary 5 0.8 unauthorized copying of this file via any medium is strictly prohibited
proprietary 5 0.8 may not be copied reproduced or distributed without (?:prior )?written permission
proprietary 5 0.8 no part of this (?:publication|book|document|work) may be reproduced
proprietary 4 0.75 this software is the confidential and proprietary information of
proprietary 2 0.6 end user licen[cs]e agreement
commercial 2 0.5 commercial licen[cs]e
commercial 3 0.6 for commercial use please contact
noncommercial 3 0.7 for (?:non commercial|noncommercial) (?:use|purposes) only
noncommercial 3 0.7 (?:personal|research|educational|academic) use only
freeware 2 0.6 this (?:software|program) is freeware
shareware 2 0.6 this (?:software|program) is shareware
dual 3 0.6 (?:dual|double) licensed under
unknown 0 0.3 licensed under
unknown 0 0.3 see (?:the )?licen[cs]e file for details
unknown 0 0.3 subject to the terms of the licen[cs]e
gpl 7 1.0 spdx license identifier gpl [123] 0(?: only| or later)?
lgpl 7 1.0 spdx license identifier lgpl [23] [01](?: only| or later)?
agpl 7 1.0 spdx license identifier agpl [13] 0(?: only| or later)?
gfdl 7 1.0 spdx license identifier gfdl 1 [123](?: only| or later)?
mit 7 1.0 spdx license identifier mit
mit-0 8 1.0 spdx license identifier mit 0
x11 7 1.0 spdx license identifier x11
apache 7 1.0 spdx license identifier apache [12](?: 0| 1)?
bsd-2-clause 7 1.0 spdx license identifier bsd 2 clause(?: patent| views)?
bsd-3-clause 7 1.0 spdx license identifier bsd 3 clause(?: clear| lbnl)?
bsd-4-clause 7 1.0 spdx license identifier bsd 4 clause(?: uc)?
0bsd 7 1.0 spdx license identifier 0bsd
isc 7 1.0 spdx license identifier isc
mpl 7 1.0 spdx license identifier mpl [12](?: 0| 1)?
epl 7 1.0 spdx license identifier epl [12] 0
cddl 7 1.0 spdx license identifier cddl 1 [01]
cpl 7 1.0 spdx license identifier cpl 1 0
ipl 7 1.0 spdx license identifier ipl 1 0
eupl 7 1.0 spdx license identifier eupl 1 [012]
artistic 7 1.0 spdx license identifier artistic [12] 0
bsl 7 1.0 spdx license identifier bsl 1 0
busl 7 1.0 spdx license identifier busl 1 1
sspl 7 1.0 spdx license identifier sspl 1 0
elastic 7 1.0 spdx license identifier elastic 2 0
zlib 7 1.0 spdx license identifier zlib
libpng 7 1.0 spdx license identifier libpng(?: 2 0)?
openssl 7 1.0 spdx license identifier openssl
curl 7 1.0 spdx license identifier curl
python 7 1.0 spdx license identifier (?:python|psf) 2 0
php 7 1.0 spdx license identifier php 3 (?:0|01)
ruby 7 1.0 spdx license identifier ruby
w3c 7 1.0 spdx license identifier w3c
odbl 7 1.0 spdx license identifier odbl 1 0
odc-by 7 1.0 spdx license identifier odc by 1 0
pddl 7 1.0 spdx license identifier pddl 1 0
ofl 7 1.0 spdx license identifier ofl 1 [01]
osl 7 1.0 spdx license identifier osl [123] [01]
afl 7 1.0 spdx license identifier afl [123] [012]
ecl 7 1.0 spdx license identifier ecl [12] 0
ms-pl 7 1.0 spdx license identifier ms pl
ms-rl 7 1.0 spdx license identifier ms rl
cecill 7 1.0 spdx license identifier cecill(?: b| c)?(?: 1| 2)?(?: 0| 1)?
mulan-psl 7 1.0 spdx license identifier mulanpsl [12] 0
apsl 7 1.0 spdx license identifier apsl [12] [012]
npl 7 1.0 spdx license identifier npl 1 [01]
qpl 7 1.0 spdx license identifier qpl 1 0
sleepycat 7 1.0 spdx license identifier sleepycat
postgresql 7 1.0 spdx license identifier postgresql
ntp 7 1.0 spdx license identifier ntp
hpnd 7 1.0 spdx license identifier hpnd
ncsa 7 1.0 spdx license identifier ncsa
upl 7 1.0 spdx license identifier upl 1 0
unicode 7 1.0 spdx license identifier unicode (?:dfs|tou|v3|3)(?: 2015| 2016| 0)?
vim 7 1.0 spdx license identifier vim
unlicense 7 1.0 spdx license identifier unlicense
wtfpl 7 1.0 spdx license identifier wtfpl
beerware 7 1.0 spdx license identifier beerware
json 7 1.0 spdx license identifier json
cc0 7 1.0 spdx license identifier cc0 1 0
cc-by 7 1.0 spdx license identifier cc by [1234] [05]
cc-by-sa 7 1.0 spdx license identifier cc by sa [1234] [05]
cc-by-nd 7 1.0 spdx license identifier cc by nd [1234] [05]
cc-by-nc 7 1.0 spdx license identifier cc by nc [1234] [05]
cc-by-nc-sa 7 1.0 spdx license identifier cc by nc sa [1234] [05]
cc-by-nc-nd 7 1.0 spdx license identifier cc by nc nd [1234] [05]
proprietary 7 1.0 spdx license identifier (?:none|noassertion|licenseref proprietary)
"""
PRIORITIES = 9


def rules() -> list[tuple[str, str, int, float]]:
    """(label, regex, priority, score) of every signature, in order."""
    cut_up = (line.split(" ", 3) for line in SIGNATURES.strip().splitlines())
    return [(label, regex, int(priority), float(score)) for label, priority, score, regex in cut_up]


#: Parts of an expression that a match may lack: groups of whole words, with the space that sets them off, and lone spaces.
_OPTIONAL = re.compile(r"\(\?:(?: (?:[^()\\]|\\.)*|(?:[^()\\]|\\.)* )\)(?:[?*]|\{0[^}]*\})\??")
#: Words by which a rule is found only if it needs no other: more texts have them than name a license.
_PLAIN = frozenset("the of to in is are and or this that under use general public open common software side source what later identifier released distributed available published".split())


def needed(regex: str) -> list[list[str]]:
    """Groups of words: each match of the expression holds at least one whole word of every group.

    A piece of the expression between spaces that are in no group is a word, or an alternation of which each
    branch gives its longest word; any other piece asks for none. The most telling group comes first.
    """
    while (bare := _OPTIONAL.sub("", regex)) != regex:
        regex = bare
    pieces, depth = [""], 0
    for c in regex.replace(" ?", "?").replace("licen[cs]es?", "(?:license|licence|licenses|licences)").replace("licen[cs]e", "(?:license|licence)"):
        depth += (c == "(") - (c == ")")
        pieces[-1:] = [pieces[-1], ""] if c == " " and not depth else [pieces[-1] + c]
    groups = []
    for piece in pieces:
        if re.fullmatch(r"[a-z0-9]+", piece):
            groups.append([piece])
        elif m := re.fullmatch(r"\(\?:([a-z0-9 |]+)\)", piece):
            groups.append(sorted({max(branch.split(), key=len) for branch in m[1].split("|")}))
    if not groups:
        raise ValueError(f"no word is sure in {regex}")
    many = lambda g: any(w in _PLAIN or w.startswith("licen") or len(w) == 1 and w != "q" for w in g)
    return sorted(groups, key=lambda g: (many(g), -min(map(len, g))))


def normalised(text: Column) -> Column:
    """Lower-case words joined by single spaces, with one space before and after; ' ' if there is none."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(ascii_lower(whole(text)), F.lit(" ")), GAPS, " ")))


def _count(text: Column) -> Column:
    """Words of a normalised text or of a piece that starts with a space before each word."""
    return F.length(text) - F.length(F.translate(text, " ", ""))


def _base(norm: Column) -> Column:
    """Array of struct (start in words, label) of the fixed phrases, by start.

    A phrase is followed by a space that the next match may need, so that space is only looked at.
    """
    pattern = F.lit(rf" (?:{'|'.join(BASE)})(?= )")
    names = F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])

    def placed(s: Column) -> Column:
        steps = F.zip_with(F.slice(s["gaps"], 1, F.size(s["hits"])), s["hits"], lambda g, h: _count(g) + _count(h))
        return F.zip_with(running(steps, plus), s["hits"], lambda e, h: F.struct((e - _count(h)).alias("start"), names[F.ltrim(h)].alias("label")))

    return let(F.struct(F.split(norm, pattern, -1).alias("gaps"), F.regexp_extract_all(norm, pattern, F.lit(0)).alias("hits")), placed)


DETECTION = "array<struct<start:int,back:int,below:int,label:string,score:double>>"


def _matches(norm: Column, words: Column, table: Column) -> Column:
    """Struct (start, -end, -priority, label, score) of every rule's matches in a normalised text, in this order.

    words: those of the text that any rule needs. A bucket of the table has the rules with one first group.
    """

    def tried(s: Column) -> Column:
        holds = lambda g: F.exists(g, lambda w: F.array_contains(s["words"], w))
        near = F.flatten(F.transform(F.filter(table, lambda b: holds(b["first"])), lambda b: b["rules"]))
        chosen = F.filter(near, lambda r: F.forall(r["needs"], holds))
        of_rule = lambda r: F.struct(r.alias("r"), match_spans(s["norm"], r["regex"], 0).alias("at"))
        places = lambda x: F.transform(x["at"], lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), (-x["r"]["priority"]).alias("below"), x["r"]["label"].alias("label"), x["r"]["score"].alias("score")))
        return F.array_sort(F.flatten(F.transform(F.transform(chosen, of_rule), places)))

    return let(F.struct(words.alias("words"), norm.alias("norm")), tried)


def _unsuppressed(found: Column) -> Column:
    """Struct (priority, start, end, label, score) of the matches that no match of higher priority holds, nor a longer one of
    equal priority. found: matches in the order of _matches.

    A match is held by one that starts no later and ends no earlier. With ends first and earlier starts next in one
    number, the largest such number so far, kept for each priority, tells whether there is one.
    """
    reach = lambda m: (-m["back"]).cast("long") * (1 << 32) - m["start"]

    def swept(d: Column) -> Column:
        there = F.array_distinct(F.transform(d, lambda m: m["below"]))
        tops = F.transform(there, lambda p: F.struct(p.alias("below"), running(F.transform(d, lambda m: F.when(m["below"] == p, reach(m)).otherwise(F.lit(-1).cast("long"))), F.greatest).alias("far")))
        held = lambda m, i, t: F.exists(t, lambda x: ((x["below"] < m["below"]) & (F.get(x["far"], i) >= reach(m))) | ((x["below"] == m["below"]) & (F.get(x["far"], i) > reach(m))))
        kept = let(tops, lambda t: F.filter(d, lambda m, i: ~held(m, i, t)))
        return F.transform(kept, lambda m: F.struct((-m["below"]).alias("priority"), m["start"].alias("start"), (-m["back"]).alias("end"), m["label"].alias("label"), m["score"].alias("score")))

    return let(found, swept)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, base, detections) of every row, repeated rows included.

    base: array<struct<start in words, label>>; detections: array of struct (priority, start and end in the
    normalised text, label, score), by start, longer ones first, then by falling priority and label; equal intervals of equal
    priority are all listed. Null text counts as empty; empty texts and texts without words have no detections. Very long texts
    are read whole, in time that grows with them. A narrow job without a shuffle; a text without a word that some rule is
    found by stops after the word count. Other columns of docs are not read.
    """
    table, firsts, vocabulary = _constant()
    none = F.array().cast(DETECTION)
    base = F.when(F.contains("norm", F.lit(" license ")), _base(F.col("norm"))).otherwise(F.array().cast("array<struct<start:int,label:string>>"))
    words = F.array_intersect(vocabulary, F.split(F.trim("norm"), " "))
    found = let(words, lambda w: F.when(F.arrays_overlap(w, firsts), _matches(F.col("norm"), w, table)).otherwise(none))
    whole_row = let(normalised(F.col(text)), lambda n: F.struct((_count(n) - 1).cast("long").alias("n_words"), n.alias("norm")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_row.alias("s")).select("doc_id", "s.*")
    rows = rows.select("doc_id", "n_words", base.alias("base"), found.alias("found"))
    return rows.select("doc_id", "n_words", "base", _unsuppressed(F.col("found")).alias("detections"))


def _constant() -> tuple[Column, Column, Column]:
    """The rules in buckets by their first group of needed words, parsed from JSON once when the plan is optimised;
    the words of first groups; all needed words."""
    buckets: dict[tuple[str, ...], list[dict]] = {}
    for label, regex, priority, score in rules():
        first, *others = needed(regex)
        buckets.setdefault(tuple(first), []).append({"label": label, "regex": f" {regex}(?= )", "priority": priority, "score": score, "needs": others})
    kind = "array<struct<first:array<string>,rules:array<struct<label:string,regex:string,priority:int,score:double,needs:array<array<string>>>>>>"
    table = F.from_json(F.lit(json.dumps([{"first": f, "rules": r} for f, r in buckets.items()])), kind)
    firsts = {w for f in buckets for w in f}
    every = firsts | {w for rs in buckets.values() for r in rs for g in r["needs"] for w in g}
    return table, *[F.split(F.lit(" ".join(sorted(x))), " ") for x in (firsts, every)]


def labels_of(base: Column, detections: Column | None = None) -> Column:
    """Distinct labels, sorted and comma-joined; `unknown`, a notice that names no license, stands only where there is no other."""
    named = F.transform(base, lambda b: b["label"])
    if detections is not None:
        named = F.concat(named, F.transform(detections, lambda d: d["label"]))
    told = lambda all_: F.when(F.size(all_) > 1, F.filter(all_, lambda x: x != "unknown")).otherwise(all_)
    return F.concat_ws(",", F.array_sort(let(F.array_distinct(named), told)))


def score_of(base: Column, detections: Column) -> Column:
    """The highest score of any detection; 0.9 for a base phrase, 0 without any."""
    best = F.coalesce(F.array_max(F.transform(detections, lambda d: d["score"])), F.lit(0.0))
    return F.greatest(best, F.when(F.size(base) > 0, F.lit(0.9)).otherwise(F.lit(0.0)))
