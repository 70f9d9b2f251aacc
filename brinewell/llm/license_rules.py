"""Hand-written signature rules of licences, for text with A-Z in lower case.

A family line has: label | name of the licence as a pattern | identifier as a pattern | address as a pattern. Each part
makes a rule of its own kind; `-` leaves a kind out. Phrase lines have: label | keyword (its longest word
gates the rule) | pattern | score. In patterns, a blank stands for white space and punctuation between words.
"""

from __future__ import annotations

FAMILIES = r"""
mit | (?:the )?mit licen[sc]e | mit | opensource\.org/licenses?/mit
mit-0 | mit no attribution licen[sc]e | mit-0 | github\.com/aws/mit-0
x11 | x11 licen[sc]e | x11 | -
isc | isc licen[sc]e | isc | opensource\.org/licenses?/isc
0bsd | (?:zero[- ]clause|0[- ]clause) bsd licen[sc]e | 0bsd | opensource\.org/licenses?/0bsd
bsd-2-clause | (?:bsd 2[- ]clause|simplified bsd|two[- ]clause bsd|freebsd) licen[sc]e | bsd-2-clause | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause | (?:bsd 3[- ]clause|new bsd|revised bsd|modified bsd|three[- ]clause bsd) licen[sc]e | bsd-3-clause | opensource\.org/licenses?/bsd-3-clause
bsd-4-clause | (?:bsd 4[- ]clause|original bsd|four[- ]clause bsd) licen[sc]e | bsd-4-clause | -
bsd | bsd(?:[- ]style)? licen[sc]e | bsd | -
apache-1.0 | apache licen[sc]e,? (?:version )?1\.0 | apache-1\.0 | apache\.org/licenses/license-1\.0
apache-1.1 | apache (?:software )?licen[sc]e,? (?:version )?1\.1 | apache-1\.1 | apache\.org/licenses/license-1\.1
apache-2.0 | apache (?:software )?licen[sc]e,? (?:version |v)?2(?:\.0)? | apache-2\.0 | apache\.org/licenses/license-2\.0
apache | apache (?:software )?licen[sc]e | - | apache\.org/licenses
gpl-1.0 | (?:gnu )?(?:general public licen[sc]e|gpl),? (?:version |v)?1(?:\.0)? | gpl-1\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0
gpl-2.0 | (?:gnu )?(?:general public licen[sc]e|gpl),? (?:version |v)?2(?:\.0)? | gpl-2\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | (?:gnu )?(?:general public licen[sc]e|gpl),? (?:version |v)?3(?:\.0)? | gpl-3\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/gpl-3\.0
gpl | (?:gnu )?general public licen[sc]e | gpl | gnu\.org/licenses/gpl
lgpl-2.0 | (?:gnu )?library general public licen[sc]e,? (?:version |v)?2(?:\.0)? | lgpl-2\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0
lgpl-2.1 | (?:gnu )?(?:lesser general public licen[sc]e|lgpl),? (?:version |v)?2\.1 | lgpl-2\.1(?:-only|-or-later|\+)? | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | (?:gnu )?(?:lesser general public licen[sc]e|lgpl),? (?:version |v)?3(?:\.0)? | lgpl-3\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/lgpl-3\.0
lgpl | (?:gnu )?(?:lesser|library) general public licen[sc]e | lgpl | gnu\.org/licenses/lgpl
agpl-3.0 | (?:gnu )?(?:affero general public licen[sc]e|agpl),? (?:version |v)?3(?:\.0)? | agpl-3\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/agpl-3\.0
agpl | (?:gnu )?affero general public licen[sc]e | agpl | gnu\.org/licenses/agpl
gfdl-1.1 | (?:gnu )?free documentation licen[sc]e,? (?:version |v)?1\.1 | gfdl-1\.1(?:-only|-or-later)? | gnu\.org/licenses/(?:old-licenses/)?fdl-1\.1
gfdl-1.2 | (?:gnu )?free documentation licen[sc]e,? (?:version |v)?1\.2 | gfdl-1\.2(?:-only|-or-later)? | gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2
gfdl-1.3 | (?:gnu )?free documentation licen[sc]e,? (?:version |v)?1\.3 | gfdl-1\.3(?:-only|-or-later)? | gnu\.org/licenses/fdl-1\.3
gfdl | (?:gnu )?free documentation licen[sc]e | gfdl | gnu\.org/licenses/fdl
mpl-1.1 | mozilla public licen[sc]e,? (?:version |v)?1\.1 | mpl-1\.1 | mozilla\.org/mpl/1\.1
mpl-2.0 | mozilla public licen[sc]e,? (?:version |v)?2(?:\.0)? | mpl-2\.0 | mozilla\.org/mpl/2\.0
mpl | mozilla public licen[sc]e | mpl | mozilla\.org/mpl
epl-1.0 | eclipse public licen[sc]e,? (?:version |v)?1(?:\.0)? | epl-1\.0 | eclipse\.org/legal/epl-v10
epl-2.0 | eclipse public licen[sc]e,? (?:version |v)?2(?:\.0)? | epl-2\.0 | eclipse\.org/legal/epl-2\.0
cddl-1.0 | common development and distribution licen[sc]e,? (?:version |v)?1\.0 | cddl-1\.0 | opensource\.org/licenses?/cddl-1\.0
cddl-1.1 | common development and distribution licen[sc]e,? (?:version |v)?1\.1 | cddl-1\.1 | -
cddl | common development and distribution licen[sc]e | cddl | opensource\.org/licenses?/cddl
cpl-1.0 | common public licen[sc]e | cpl-1\.0 | opensource\.org/licenses?/cpl
eupl-1.1 | european union public licen[sc]e,? (?:version |v)?\.? ?1\.1 | eupl-1\.1 | -
eupl-1.2 | european union public licen[sc]e,? (?:version |v)?\.? ?1\.2 | eupl-1\.2 | joinup\.ec\.europa\.eu/[a-z/-]{0,40}eupl
artistic-1.0 | artistic licen[sc]e,? (?:version |v)?1\.0 | artistic-1\.0(?:-perl|-cl8)? | opensource\.org/licenses?/artistic-1
artistic-2.0 | artistic licen[sc]e,? (?:version |v)?2\.0 | artistic-2\.0 | opensource\.org/licenses?/artistic-2
artistic | artistic licen[sc]e | - | -
bsl-1.0 | boost software licen[sc]e | bsl-1\.0 | boost\.org/license
busl-1.1 | business source licen[sc]e | busl-1\.1 | mariadb\.com/bsl
zlib | zlib(?:/libpng)? licen[sc]e | zlib | opensource\.org/licenses?/zlib
libpng | libpng licen[sc]e | libpng(?:-2\.0)? | libpng\.org/pub/png/src/libpng-license
unlicense | the unlicense | unlicense | unlicense\.org
wtfpl | do what the f\w{0,4} you want to public licen[sc]e | wtfpl | wtfpl\.net
cc0-1.0 | (?:cc0|creative commons zero)(?: v?1\.0)? (?:universal|licen[sc]e|public domain) | cc0-1\.0 | creativecommons\.org/publicdomain/zero
cc-by-4.0 | (?:cc[- ]by|creative commons attribution)(?: licen[sc]e)?[ -]?4\.0 | cc-by-4\.0 | creativecommons\.org/licenses/by/4\.0
cc-by-3.0 | (?:cc[- ]by|creative commons attribution)(?: licen[sc]e)?[ -]?3\.0 | cc-by-3\.0 | creativecommons\.org/licenses/by/3\.0
cc-by-2.0 | (?:cc[- ]by|creative commons attribution)(?: licen[sc]e)?[ -]?2\.0 | cc-by-2\.0 | creativecommons\.org/licenses/by/2\.0
cc-by | creative commons attribution licen[sc]e | - | creativecommons\.org/licenses/by/
cc-by-sa-4.0 | (?:cc[- ]by[- ]sa|creative commons attribution[- ]sharealike)(?: licen[sc]e)?[ -]?4\.0 | cc-by-sa-4\.0 | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 | (?:cc[- ]by[- ]sa|creative commons attribution[- ]sharealike)(?: licen[sc]e)?[ -]?3\.0 | cc-by-sa-3\.0 | creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-2.0 | (?:cc[- ]by[- ]sa|creative commons attribution[- ]sharealike)(?: licen[sc]e)?[ -]?2\.0 | cc-by-sa-2\.0 | creativecommons\.org/licenses/by-sa/2\.0
cc-by-sa | creative commons attribution[- ]sharealike licen[sc]e | - | creativecommons\.org/licenses/by-sa/
cc-by-nd-4.0 | (?:cc[- ]by[- ]nd|creative commons attribution[- ]noderivat(?:ive|e)s)(?: licen[sc]e)?[ -]?4\.0 | cc-by-nd-4\.0 | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nd-3.0 | (?:cc[- ]by[- ]nd|creative commons attribution[- ]noderivat(?:ive|e)s)(?: licen[sc]e)?[ -]?3\.0 | cc-by-nd-3\.0 | creativecommons\.org/licenses/by-nd/3\.0
cc-by-nc-4.0 | (?:cc[- ]by[- ]nc|creative commons attribution[- ]noncommercial)(?: licen[sc]e)?[ -]?4\.0 | cc-by-nc-4\.0 | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-3.0 | (?:cc[- ]by[- ]nc|creative commons attribution[- ]noncommercial)(?: licen[sc]e)?[ -]?3\.0 | cc-by-nc-3\.0 | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc | creative commons attribution[- ]noncommercial licen[sc]e | - | creativecommons\.org/licenses/by-nc/
cc-by-nc-sa-4.0 | (?:cc[- ]by[- ]nc[- ]sa|creative commons attribution[- ]noncommercial[- ]sharealike)(?: licen[sc]e)?[ -]?4\.0 | cc-by-nc-sa-4\.0 | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-sa-3.0 | (?:cc[- ]by[- ]nc[- ]sa|creative commons attribution[- ]noncommercial[- ]sharealike)(?: licen[sc]e)?[ -]?3\.0 | cc-by-nc-sa-3\.0 | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-nd-4.0 | (?:cc[- ]by[- ]nc[- ]nd|creative commons attribution[- ]noncommercial[- ]noderivat(?:ive|e)s)(?: licen[sc]e)?[ -]?4\.0 | cc-by-nc-nd-4\.0 | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-nd-3.0 | (?:cc[- ]by[- ]nc[- ]nd|creative commons attribution[- ]noncommercial[- ]noderivat(?:ive|e)s)(?: licen[sc]e)?[ -]?3\.0 | cc-by-nc-nd-3\.0 | creativecommons\.org/licenses/by-nc-nd/3\.0
odbl-1.0 | open database licen[sc]e | odbl-1\.0 | opendatacommons\.org/licenses/odbl
odc-by-1.0 | open data commons attribution licen[sc]e | odc-by-1\.0 | opendatacommons\.org/licenses/by
pddl-1.0 | public domain dedication (?:and|&) licen[sc]e | pddl-1\.0 | opendatacommons\.org/licenses/pddl
psf-2.0 | python software foundation licen[sc]e | (?:psf|python)-2\.0(?:\.1)? | docs\.python\.org/[0-9./a-z]{0,12}license
php-3.01 | php licen[sc]e,? (?:version |v)?3\.0?1 | php-3\.01 | php\.net/license/3_01
php | php licen[sc]e | php-3\.0 | php\.net/license
ruby | ruby licen[sc]e | ruby | ruby-lang\.org/[a-z/]{0,20}license
postgresql | postgresql licen[sc]e | postgresql | postgresql\.org/about/licen[sc]e
openssl | openssl licen[sc]e | openssl | openssl\.org/source/license
curl | curl licen[sc]e | curl | curl\.(?:se|haxx\.se)/docs/copyright
ncsa | (?:university of illinois/)?ncsa open source licen[sc]e | ncsa | opensource\.org/licenses?/ncsa
ms-pl | microsoft public licen[sc]e | ms-pl | opensource\.org/licenses?/ms-pl
ms-rl | microsoft reciprocal licen[sc]e | ms-rl | opensource\.org/licenses?/ms-rl
ofl-1.1 | (?:sil )?open font licen[sc]e | ofl-1\.1(?:-rfn|-no-rfn)? | scripts\.sil\.org/ofl
osl-3.0 | open software licen[sc]e | osl-3\.0 | opensource\.org/licenses?/osl-3\.0
afl-3.0 | academic free licen[sc]e | afl-[123]\.[01] | opensource\.org/licenses?/afl-3\.0
qpl-1.0 | q public licen[sc]e | qpl-1\.0 | opensource\.org/licenses?/qtpl
ipl-1.0 | ibm public licen[sc]e | ipl-1\.0 | opensource\.org/licenses?/ipl
spl-1.0 | sun public licen[sc]e | spl-1\.0 | opensource\.org/licenses?/spl
nasa-1.3 | nasa open source agreement licen[sc]e | nasa-1\.3 | opensource\.org/licenses?/nasa1\.3
upl-1.0 | universal permissive licen[sc]e | upl-1\.0 | oss\.oracle\.com/licenses/upl
vim | vim licen[sc]e | vim | vimhelp\.org/uganda
sspl-1.0 | server side public licen[sc]e | sspl-1\.0 | mongodb\.com/licensing/server-side-public-license
elastic-2.0 | elastic licen[sc]e | elastic-2\.0 | elastic\.co/licensing/elastic-license
openrail-m | (?:bigscience |creativeml )?(?:open )?rail(?:\+\+)?[- ]m licen[sc]e | (?:bigscience-|creativeml-)?openrail(?:-m)? | huggingface\.co/spaces/[a-z]{1,20}/license
llama-community | llama [0-9. ]{0,4}community licen[sc]e | llama[0-9.]{0,4} | llama\.meta\.com/[a-z0-9/]{0,20}license
ecl-2.0 | educational community licen[sc]e | ecl-2\.0 | opensource\.org/licenses?/ecl
blueoak-1.0.0 | blue oak model licen[sc]e | blueoak-1\.0\.0 | blueoakcouncil\.org/license
mulan-psl-2.0 | mulan permissive software licen[sc]e | mulanpsl-2\.0 | license\.coscl\.org\.cn/mulanpsl2
hippocratic-2.1 | hippocratic licen[sc]e | hippocratic-2\.1 | firstdonoharm\.dev
json | json licen[sc]e | json | json\.org/license
cecill-2.1 | cecill(?: free software)? licen[sc]e | cecill-[12]\.[01] | cecill\.info/licences
polyform | polyform [a-z]{3,16} licen[sc]e | polyform-[a-z]{3,16}-1\.0\.0 | polyformproject\.org/licenses
parity-7.0.0 | parity public licen[sc]e | parity-[67]\.0\.0 | paritylicense\.com
"""

PHRASES = r"""
mit | permission is hereby | permission is hereby granted,? free of charge,? to any person obtaining a copy | 0.95
mit-0 | to deal in the software | to deal in the software without restriction | 0.6
isc | permission to use | permission to use,? copy,? modify,? and/or distribute this software for any purpose | 0.9
bsd | redistribution and use | redistribution and use in source and binary forms,? with or without modification,? are permitted | 0.95
bsd-3-clause | neither the name | neither the name of .{1,80}? nor the names of its contributors | 0.9
bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software must display | 0.9
apache-2.0 | licensed under the apache | licensed under the apache licen[sc]e,? version 2\.0 | 0.97
apache-2.0 | you may not use this file | you may not use this file except in compliance with the licen[sc]e | 0.8
gpl | free software foundation | under the terms of the gnu general public licen[sc]e as published by the free software foundation | 0.97
gpl-2.0 | or any later version | either version 2 of the licen[sc]e,? or \(?at your option\)? any later version | 0.9
gpl-3.0 | or any later version | either version 3 of the licen[sc]e,? or \(?at your option\)? any later version | 0.9
gpl | gnu gpl | (?:licensed|distributed|released) under the gnu gpl | 0.9
lgpl | gnu lgpl | (?:licensed|distributed|released) under the gnu lgpl | 0.9
agpl | gnu agpl | (?:licensed|distributed|released) under the gnu agpl | 0.9
mpl-2.0 | source code form | this source code form is subject to the terms of the mozilla public licen[sc]e | 0.97
epl-1.0 | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e | 0.95
zlib | altered source versions | altered source versions must be plainly marked as such | 0.9
bsl-1.0 | boost software | distributed under the boost software licen[sc]e | 0.97
unlicense | released into the public domain | this is free and unencumbered software released into the public domain | 0.97
public-domain | public domain | (?:dedicated to|placed in(?:to)?|released (?:in)?to|is in) the public domain | 0.7
public-domain | gemeinfrei | (?:ist|sind) gemeinfrei | 0.5
public-domain | domaine public | (?:dans|du) le domaine public | 0.4
public-domain | dominio público | (?:en|de) (?:el )?dominio público | 0.4
cc0-1.0 | waived all copyright | has waived all copyright and related or neighbou?ring rights | 0.9
cc | creative commons licen | licensed under (?:a|the) creative commons licen[sc]e | 0.6
ofl-1.1 | reserved font name | with reserved font name | 0.8
wtfpl | you just do what | you just do what the f\w{0,4} you want to | 0.95
artistic | the artistic licen | same terms as perl itself under the artistic licen[sc]e | 0.7
postgresql | paragraphs appear in all copies | provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies | 0.9
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit | 0.9
curl | permission to use | permission to use,? copy,? modify,? and distribute this software for any purpose with or without fee | 0.8
beerware | beer-ware licen | the beer-ware licen[sc]e | 0.95
proprietary | all rights reserved | all rights reserved | 0.4
proprietary | confidential and proprietary | confidential and proprietary | 0.6
proprietary | without prior written | (?:may|must) not be (?:copied|reproduced|distributed) without (?:the )?prior written (?:permission|consent) | 0.6
proprietary | end user licen | end user licen[sc]e agreement | 0.5
proprietary | for internal use only | for internal use only | 0.5
non-commercial | non-commercial use only | (?:for )?non-commercial use only | 0.6
non-commercial | noncommercial purposes | for noncommercial purposes (?:only)? | 0.5
research-only | research purposes only | for research purposes only | 0.6
dual | dual licensed | dual licensed under | 0.5
copyright-notice | copyright | copyright (?:c |© ?)?(?:19|20)[0-9]{2} | 0.3
"""
