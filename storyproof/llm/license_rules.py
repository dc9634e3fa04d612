"""Signatures of licences, written by hand, over the words of a text: lower case, one space between words.

A line holds: keyword, label, priority (3: name with version, tag, address or the licence's own wording; 2: name; 1: allusion),
weight, expression. The keyword is a word or two that any match holds; an expression matches whole words.
"""

RULES_TEXT = r"""
apache | apache-2.0 | 3 | 1.0 | apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?
apache | apache-2.0 | 3 | 1.0 | apache 2(?: 0)?(?: licen[cs]e)?
apache | apache-2.0 | 3 | 1.0 | www apache org licenses license 2 0(?: txt| html)?
apache | apache-2.0 | 3 | 1.0 | spdx license identifier apache 2 0
apache | apache-2.0 | 3 | 0.9 | apachev2|apache2(?: 0)?
apache | apache-2.0 | 3 | 0.9 | asl 2 0 apache
apache | apache-1.1 | 3 | 1.0 | apache (?:software )?licen[cs]e (?:version |v )?1 1
apache | apache-1.1 | 3 | 1.0 | spdx license identifier apache 1 1
apache | apache-1.0 | 3 | 1.0 | apache (?:software )?licen[cs]e (?:version |v )?1 0
apache | apache-1.0 | 3 | 1.0 | spdx license identifier apache 1 0
apache | apache | 2 | 0.8 | apache (?:software )?licen[cs]e
apache | apache | 1 | 0.5 | (?:under|with) (?:the )?apache (?:terms|conditions)
apache | apache-2.0 | 3 | 0.9 | licensed to the apache software foundation asf under one or more contributor license agreements
mit license | mit | 3 | 1.0 | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit license
mit license | mit | 2 | 0.9 | mit license
mit | mit | 3 | 1.0 | spdx license identifier mit
mit | mit | 3 | 1.0 | opensource org licenses mit(?: license(?: php| html)?)?
mit | mit | 2 | 0.8 | mit licen[cs]ed?
mit | mit | 2 | 0.8 | mit x11 licen[cs]e|x11 mit licen[cs]e
mit | mit | 2 | 0.7 | expat mit licen[cs]e|mit expat licen[cs]e
mit | mit-0 | 3 | 1.0 | mit no attribution|mit 0 licen[cs]e|spdx license identifier mit 0
mit | mit | 1 | 0.5 | licen[cs]e mit|licensed mit
free of charge | mit | 3 | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of this software
provided as is | mit | 1 | 0.4 | the software is provided as is without warranty of any kind
general public | gpl-3.0 | 3 | 1.0 | gnu general public licen[cs]e (?:as published by the free software foundation either )?(?:version |v )?3(?: 0)?
general public | gpl-3.0-or-later | 3 | 1.0 | gnu general public licen[cs]e (?:version |v )?3(?: 0)? or (?:any )?later
general public | gpl-2.0 | 3 | 1.0 | gnu general public licen[cs]e (?:as published by the free software foundation either )?(?:version |v )?2(?: 0)?
general public | gpl-2.0-or-later | 3 | 1.0 | gnu general public licen[cs]e (?:version |v )?2(?: 0)? or (?:any )?later
general public | gpl-1.0 | 3 | 1.0 | gnu general public licen[cs]e (?:version |v )?1(?: 0)?
general public | gpl | 2 | 0.8 | gnu general public licen[cs]e
general public | gpl | 1 | 0.5 | general public licen[cs]e
general public | agpl-3.0 | 3 | 1.0 | gnu affero general public licen[cs]e (?:version |v )?3(?: 0)?
general public | agpl | 2 | 0.8 | (?:gnu )?affero general public licen[cs]e
general public | lgpl-3.0 | 3 | 1.0 | gnu lesser general public licen[cs]e (?:version |v )?3(?: 0)?
general public | lgpl-2.1 | 3 | 1.0 | gnu lesser general public licen[cs]e (?:version |v )?2 1
general public | lgpl-2.0 | 3 | 1.0 | gnu library general public licen[cs]e (?:version |v )?2(?: 0)?
general public | lgpl | 2 | 0.8 | (?:gnu )?(?:lesser|library) general public licen[cs]e
gpl | gpl-3.0 | 3 | 1.0 | spdx license identifier gpl 3 0(?: only)?
gpl | gpl-3.0-or-later | 3 | 1.0 | spdx license identifier gpl 3 0 or later
gpl | gpl-2.0 | 3 | 1.0 | spdx license identifier gpl 2 0(?: only)?
gpl | gpl-2.0-or-later | 3 | 1.0 | spdx license identifier gpl 2 0 or later
gpl | gpl-3.0 | 3 | 0.9 | gplv3|gpl3|gpl (?:version |v )?3(?: 0)?
gpl | gpl-3.0-or-later | 3 | 0.9 | gpl (?:version |v )?3(?: 0)? or later
gpl | gpl-2.0 | 3 | 0.9 | gplv2|gpl2|gpl (?:version |v )?2(?: 0)?
gpl | gpl-2.0-or-later | 3 | 0.9 | gpl (?:version |v )?2(?: 0)? or later
gpl | gpl | 2 | 0.7 | gnu gpl|gpl licen[cs]ed?
gpl | gpl | 1 | 0.5 | under (?:the )?gpl
gpl | lgpl-3.0 | 3 | 1.0 | spdx license identifier lgpl 3 0(?: only| or later)?
gpl | lgpl-2.1 | 3 | 1.0 | spdx license identifier lgpl 2 1(?: only| or later)?
gpl | lgpl-3.0 | 3 | 0.9 | lgplv3|lgpl3|lgpl (?:version |v )?3(?: 0)?
gpl | lgpl-2.1 | 3 | 0.9 | lgplv2 1|lgpl (?:version |v )?2 1
gpl | lgpl | 2 | 0.7 | gnu lgpl|lgpl licen[cs]ed?
gpl | agpl-3.0 | 3 | 1.0 | spdx license identifier agpl 3 0(?: only| or later)?
gpl | agpl-3.0 | 3 | 0.9 | agplv3|agpl3|agpl (?:version |v )?3(?: 0)?
gpl | agpl | 2 | 0.7 | gnu agpl|agpl licen[cs]ed?
gnu org | gpl-3.0 | 3 | 1.0 | gnu org licenses gpl(?: 3 0)?(?: en)?(?: html| txt)?
gnu org | gpl-2.0 | 3 | 1.0 | gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?
gnu org | lgpl-3.0 | 3 | 1.0 | gnu org licenses lgpl(?: 3 0)?(?: en)?(?: html| txt)?
gnu org | agpl-3.0 | 3 | 1.0 | gnu org licenses agpl(?: 3 0)?(?: en)?(?: html| txt)?
gnu org | gfdl | 3 | 1.0 | gnu org licenses fdl(?: 1 3)?(?: en)?(?: html| txt)?
free documentation | gfdl-1.3 | 3 | 1.0 | gnu free documentation licen[cs]e (?:version |v )?1 3
free documentation | gfdl-1.2 | 3 | 1.0 | gnu free documentation licen[cs]e (?:version |v )?1 2
free documentation | gfdl | 2 | 0.8 | (?:gnu )?free documentation licen[cs]e
free software foundation | gpl | 1 | 0.4 | terms of the gnu licen[cs]e as published by the free software foundation
cc by | cc-by-4.0 | 3 | 1.0 | cc by 4(?: 0)?
cc by | cc-by-3.0 | 3 | 1.0 | cc by 3(?: 0)?
cc by | cc-by-2.5 | 3 | 1.0 | cc by 2 5
cc by | cc-by-2.0 | 3 | 1.0 | cc by 2 0
cc by | cc-by | 2 | 0.7 | cc by
cc by | cc-by-sa-4.0 | 3 | 1.0 | cc by sa 4(?: 0)?
cc by | cc-by-sa-3.0 | 3 | 1.0 | cc by sa 3(?: 0)?
cc by | cc-by-sa-2.5 | 3 | 1.0 | cc by sa 2 5
cc by | cc-by-sa | 2 | 0.8 | cc by sa
cc by | cc-by-nc-4.0 | 3 | 1.0 | cc by nc 4(?: 0)?
cc by | cc-by-nc-3.0 | 3 | 1.0 | cc by nc 3(?: 0)?
cc by | cc-by-nc | 2 | 0.8 | cc by nc
cc by | cc-by-nd-4.0 | 3 | 1.0 | cc by nd 4(?: 0)?
cc by | cc-by-nd-3.0 | 3 | 1.0 | cc by nd 3(?: 0)?
cc by | cc-by-nd | 2 | 0.8 | cc by nd
cc by | cc-by-nc-sa-4.0 | 3 | 1.0 | cc by nc sa 4(?: 0)?
cc by | cc-by-nc-sa-3.0 | 3 | 1.0 | cc by nc sa 3(?: 0)?
cc by | cc-by-nc-sa | 2 | 0.8 | cc by nc sa
cc by | cc-by-nc-nd-4.0 | 3 | 1.0 | cc by nc nd 4(?: 0)?
cc by | cc-by-nc-nd-3.0 | 3 | 1.0 | cc by nc nd 3(?: 0)?
cc by | cc-by-nc-nd | 2 | 0.8 | cc by nc nd
cc0 | cc0-1.0 | 3 | 1.0 | cc0 1 0(?: universal)?
cc0 | cc0-1.0 | 3 | 1.0 | spdx license identifier cc0 1 0
cc0 | cc0 | 2 | 0.8 | cc0(?: licen[cs]e| public domain)?
creative commons | cc-by-4.0 | 3 | 1.0 | creative commons attribution 4(?: 0)?(?: international)?
creative commons | cc-by-3.0 | 3 | 1.0 | creative commons attribution 3(?: 0)?(?: unported)?
creative commons | cc-by | 2 | 0.8 | creative commons attribution(?: licen[cs]e)?
creative commons | cc-by-sa-4.0 | 3 | 1.0 | creative commons attribution share ?alike 4(?: 0)?(?: international)?
creative commons | cc-by-sa-3.0 | 3 | 1.0 | creative commons attribution share ?alike 3(?: 0)?(?: unported)?
creative commons | cc-by-sa | 2 | 0.8 | creative commons attribution share ?alike
creative commons | cc-by-nc-4.0 | 3 | 1.0 | creative commons attribution non ?commercial 4(?: 0)?(?: international)?
creative commons | cc-by-nc | 2 | 0.8 | creative commons attribution non ?commercial
creative commons | cc-by-nd-4.0 | 3 | 1.0 | creative commons attribution no ?deriv(?:atives|s)? 4(?: 0)?
creative commons | cc-by-nd | 2 | 0.8 | creative commons attribution no ?deriv(?:atives|s)?
creative commons | cc-by-nc-sa-4.0 | 3 | 1.0 | creative commons attribution non ?commercial share ?alike 4(?: 0)?
creative commons | cc-by-nc-sa | 2 | 0.8 | creative commons attribution non ?commercial share ?alike
creative commons | cc-by-nc-nd-4.0 | 3 | 1.0 | creative commons attribution non ?commercial no ?deriv(?:atives|s)? 4(?: 0)?
creative commons | cc-by-nc-nd | 2 | 0.8 | creative commons attribution non ?commercial no ?deriv(?:atives|s)?
creative commons | cc0-1.0 | 3 | 1.0 | creative commons zero(?: v?1 0)?(?: universal)?
creative commons | cc-unknown | 1 | 0.5 | creative commons(?: licen[cs]e[ds]?)?
creativecommons | cc-by-4.0 | 3 | 1.0 | creativecommons org licenses by 4 0
creativecommons | cc-by-3.0 | 3 | 1.0 | creativecommons org licenses by 3 0
creativecommons | cc-by-2.0 | 3 | 1.0 | creativecommons org licenses by 2 0
creativecommons | cc-by-sa-4.0 | 3 | 1.0 | creativecommons org licenses by sa 4 0
creativecommons | cc-by-sa-3.0 | 3 | 1.0 | creativecommons org licenses by sa 3 0
creativecommons | cc-by-nc-4.0 | 3 | 1.0 | creativecommons org licenses by nc 4 0
creativecommons | cc-by-nd-4.0 | 3 | 1.0 | creativecommons org licenses by nd 4 0
creativecommons | cc-by-nc-sa-4.0 | 3 | 1.0 | creativecommons org licenses by nc sa 4 0
creativecommons | cc-by-nc-sa-3.0 | 3 | 1.0 | creativecommons org licenses by nc sa 3 0
creativecommons | cc-by-nc-nd-4.0 | 3 | 1.0 | creativecommons org licenses by nc nd 4 0
creativecommons | cc0-1.0 | 3 | 1.0 | creativecommons org publicdomain zero 1 0
creativecommons | public-domain | 3 | 0.9 | creativecommons org publicdomain mark 1 0
creativecommons | cc-unknown | 1 | 0.5 | creativecommons org
bsd | bsd-3-clause | 3 | 1.0 | bsd 3 clause|3 clause bsd|three clause bsd|new bsd licen[cs]e|modified bsd licen[cs]e|revised bsd licen[cs]e
bsd | bsd-2-clause | 3 | 1.0 | bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd licen[cs]e|freebsd licen[cs]e
bsd | bsd-4-clause | 3 | 1.0 | bsd 4 clause|4 clause bsd|four clause bsd|original bsd licen[cs]e
bsd | 0bsd | 3 | 1.0 | spdx license identifier 0bsd|zero clause bsd|bsd zero clause
bsd | bsd-3-clause | 3 | 1.0 | opensource org licenses bsd 3 clause
bsd | bsd-2-clause | 3 | 1.0 | opensource org licenses bsd 2 clause
bsd | bsd | 2 | 0.7 | bsd (?:style )?licen[cs]ed?
redistribution and use | bsd | 3 | 0.9 | redistribution and use in source and binary forms with or without modification are permitted
neither the name | bsd-3-clause | 3 | 0.9 | neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote
advertising materials | bsd-4-clause | 3 | 0.9 | all advertising materials mentioning features or use of this software must display
mozilla | mpl-2.0 | 3 | 1.0 | mozilla public licen[cs]e (?:version |v )?2(?: 0)?
mozilla | mpl-1.1 | 3 | 1.0 | mozilla public licen[cs]e (?:version |v )?1 1
mozilla | mpl-1.0 | 3 | 1.0 | mozilla public licen[cs]e (?:version |v )?1 0
mozilla | mpl | 2 | 0.8 | mozilla public licen[cs]e
mozilla | mpl-2.0 | 3 | 1.0 | mozilla org (?:en us )?mpl 2 0
mpl | mpl-2.0 | 3 | 0.9 | mpl 2 0|mplv2|spdx license identifier mpl 2 0
mpl | mpl-1.1 | 3 | 0.9 | mpl 1 1|spdx license identifier mpl 1 1
eclipse | epl-2.0 | 3 | 1.0 | eclipse public licen[cs]e (?:version |v )?2(?: 0)?
eclipse | epl-1.0 | 3 | 1.0 | eclipse public licen[cs]e (?:version |v )?1(?: 0)?
eclipse | epl | 2 | 0.8 | eclipse public licen[cs]e
eclipse | edl-1.0 | 3 | 1.0 | eclipse distribution licen[cs]e (?:version |v )?1 0
epl | epl-2.0 | 3 | 0.9 | epl 2 0|spdx license identifier epl 2 0
epl | epl-1.0 | 3 | 0.9 | epl 1 0|spdx license identifier epl 1 0
common development | cddl-1.1 | 3 | 1.0 | common development and distribution licen[cs]e (?:version |v )?1 1
common development | cddl-1.0 | 3 | 1.0 | common development and distribution licen[cs]e (?:version |v )?1 0
common development | cddl | 2 | 0.8 | common development and distribution licen[cs]e
cddl | cddl-1.0 | 3 | 0.9 | cddl 1 0|spdx license identifier cddl 1 0
common public | cpl-1.0 | 3 | 1.0 | common public licen[cs]e (?:version |v )?1 0
common public | cpl | 2 | 0.8 | common public licen[cs]e
isc | isc | 2 | 0.8 | isc licen[cs]e
isc | isc | 3 | 1.0 | spdx license identifier isc
purpose with or without fee | isc | 3 | 1.0 | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
zlib | zlib | 2 | 0.8 | zlib (?:libpng )?licen[cs]e
zlib | zlib | 3 | 1.0 | spdx license identifier zlib
origin of this software | zlib | 3 | 0.9 | the origin of this software must not be misrepresented
libpng | libpng | 2 | 0.8 | libpng licen[cs]e|spdx license identifier libpng 2 0
boost | bsl-1.0 | 3 | 1.0 | boost software licen[cs]e (?:version |v )?1 0
boost | bsl-1.0 | 2 | 0.8 | boost (?:software )?licen[cs]e
bsl | bsl-1.0 | 3 | 1.0 | spdx license identifier bsl 1 0
business source | busl-1.1 | 3 | 1.0 | business source licen[cs]e (?:version |v )?1 1
business source | busl | 2 | 0.8 | business source licen[cs]e
server side public | sspl-1.0 | 3 | 1.0 | server side public licen[cs]e(?: (?:version |v )?1(?: 0)?)?
elastic | elastic-2.0 | 3 | 1.0 | elastic licen[cs]e (?:version |v )?2(?: 0)?
elastic | elastic | 2 | 0.7 | elastic licen[cs]e
unlicense | unlicense | 2 | 0.9 | the unlicense|unlicense org|spdx license identifier unlicense
public domain | unlicense | 3 | 0.9 | this is free and unencumbered software released into the public domain
public domain | public-domain | 2 | 0.7 | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
public domain | pddl-1.0 | 3 | 1.0 | public domain dedication and licen[cs]e
wtfpl | wtfpl | 2 | 0.9 | wtfpl(?: licen[cs]e)?
artistic | artistic-2.0 | 3 | 1.0 | artistic licen[cs]e (?:version |v )?2(?: 0)?
artistic | artistic-1.0 | 3 | 1.0 | artistic licen[cs]e (?:version |v )?1(?: 0)?
artistic | artistic | 2 | 0.7 | artistic licen[cs]e
perl | artistic-or-gpl | 1 | 0.5 | same terms as perl(?: itself)?
academic free | afl-3.0 | 3 | 1.0 | academic free licen[cs]e (?:version |v )?3(?: 0)?
academic free | afl | 2 | 0.8 | academic free licen[cs]e
open software | osl-3.0 | 3 | 1.0 | open software licen[cs]e (?:version |v )?3(?: 0)?
open software | osl | 2 | 0.7 | open software licen[cs]e
european union | eupl-1.2 | 3 | 1.0 | european union public licen[cs]e (?:version |v )?1 2
european union | eupl | 2 | 0.8 | european union public licen[cs]e
eupl | eupl-1.2 | 3 | 0.9 | eupl (?:v )?1 2
microsoft | ms-pl | 2 | 0.8 | microsoft public licen[cs]e
microsoft | ms-rl | 2 | 0.8 | microsoft reciprocal licen[cs]e
python software | psf-2.0 | 2 | 0.8 | python software foundation licen[cs]e(?: version 2)?
php | php-3.01 | 3 | 1.0 | php licen[cs]e (?:version |v )?3 01
php | php | 2 | 0.7 | php licen[cs]e
ruby | ruby | 2 | 0.7 | ruby licen[cs]e
open font | ofl-1.1 | 3 | 1.0 | (?:sil )?open font licen[cs]e (?:version |v )?1 1
open font | ofl | 2 | 0.8 | (?:sil )?open font licen[cs]e
open data commons | odc-by-1.0 | 3 | 1.0 | open data commons attribution licen[cs]e(?: v?1 0)?
open data commons | odbl-1.0 | 3 | 1.0 | open data commons open database licen[cs]e(?: v?1 0)?
open database | odbl | 2 | 0.8 | open database licen[cs]e
odbl | odbl | 2 | 0.7 | odbl(?: v?1 0)?
odc by | odc-by | 2 | 0.7 | odc by(?: v?1 0)?
community data | cdla | 2 | 0.8 | community data licen[cs]e agreement(?: (?:permissive|sharing))?
open government | ogl-3.0 | 3 | 1.0 | open government licen[cs]e (?:version |v )?3(?: 0)?
open government | ogl | 2 | 0.8 | open government licen[cs]e
etalab | etalab-2.0 | 2 | 0.8 | (?:licence ouverte )?etalab(?: 2 0)?
responsible ai | openrail | 2 | 0.8 | responsible ai licen[cs]e|open responsible ai licen[cs]e
openrail | openrail-m | 3 | 0.9 | (?:creativeml )?(?:bigscience )?openrail m
llama | llama-community | 3 | 0.9 | llama (?:\d )?(?:\d )?community licen[cs]e(?: agreement)?
mulan | mulanpsl-2.0 | 3 | 1.0 | mulan (?:psl|permissive software licen[cs]e) (?:version |v )?2(?: 0)?
postgresql | postgresql | 2 | 0.8 | postgresql licen[cs]e
openssl | openssl | 2 | 0.8 | openssl licen[cs]e
sleepycat | sleepycat | 2 | 0.8 | sleepycat licen[cs]e
vim | vim | 2 | 0.7 | vim licen[cs]e
beerware | beerware | 2 | 0.8 | beerware licen[cs]e|licen[cs]e beerware
hippocratic | hippocratic | 2 | 0.8 | hippocratic licen[cs]e
parity | parity | 2 | 0.6 | parity public licen[cs]e
polyform | polyform | 2 | 0.8 | polyform (?:noncommercial|small business|shield|strict|free trial|internal use) licen[cs]e
commons clause | commons-clause | 2 | 0.8 | commons clause(?: licen[cs]e)?
all rights reserved | proprietary | 1 | 0.3 | all rights reserved
terms of use | proprietary | 1 | 0.2 | subject to (?:the )?terms of use
end user | proprietary | 2 | 0.6 | end user licen[cs]e agreement
"""


def rules() -> list[dict]:
    """The lines above in order, as dicts."""
    out = []
    for line in filter(None, RULES_TEXT.split("\n")):
        keyword, label, priority, weight, pattern = line.split(" | ", 4)
        out.append({"rule": len(out), "keyword": keyword.strip(), "label": label, "priority": int(priority), "weight": float(weight), "pattern": pattern})
    return out
