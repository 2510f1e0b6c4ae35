"""The signature rules of license scans, in the order of their families.

One rule a line: label, kind, keyword, regular expression. Expressions run over words in lower case joined by single
spaces and match whole words. A rule runs only if a word of the text begins with its keyword, so every match of its
expression must hold such a word. Between angle brackets stand the short forms of FORMS. A kind gives a rule's
priority and how sure a detection by it is.
"""

from __future__ import annotations

#: Kind -> (priority, strength).
KINDS = {
    "spdx-later": (95, 1.0), "spdx": (90, 1.0), "url": (85, 1.0), "header-later": (80, 0.95), "header": (75, 0.95), "grant": (65, 0.95),
    "version-later": (60, 0.9), "version": (55, 0.9), "short-later": (50, 0.8), "short": (45, 0.8), "text": (40, 0.7), "name": (20, 0.6), "hint": (10, 0.5),
}

#: What the short forms in rules stand for.
FORMS = {
    "id": "spdx license identifier",
    "v": "(?:version |ver |v ?)?",
    "later": "(?:or (?:at your option )?(?:any )?(?:later|newer|greater)(?: versions?)?|and (?:any )?later(?: versions?)?)",
    "option": "(?:or at your option any later version|or any later version)",
    "under": "(?:(?:re)?licen[sc]ed|distributed|released|published|provided|available|covered) (?:only )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?",
    "lic": "licen[sc]es?",
    "bare": "(?! (?:version |ver |v ?)?[0-9])",
    "far": "(?: [^ ]+){0,12}",
}

#: The rules.
RULES = r"""
# GNU General Public License
gpl-1-or-later | spdx-later | gpl | <id> gpl 1 0 or later
gpl-1 | spdx | gpl | <id> gpl 1 0(?: only)?
gpl-2-or-later | spdx-later | gpl | <id> gpl 2 0 or later
gpl-2 | spdx | gpl | <id> gpl 2 0(?: only)?
gpl-2-with-classpath | spdx-later | classpath | <id> gpl 2 0(?: only| or later)? with classpath exception 2 0
gpl-2-with-linux-syscall | spdx-later | linux | <id> gpl 2 0(?: only| or later)? with linux syscall note
gpl-3-or-later | spdx-later | gpl | <id> gpl 3 0 or later
gpl-3 | spdx | gpl | <id> gpl 3 0(?: only)?
gpl-3-with-gcc-exception | spdx-later | gcc | <id> gpl 3 0(?: only| or later)? with gcc exception 3 1
gpl-1-or-later | header-later | gnu | gnu general public license<far> either version 1 of the license <option>
gpl-2-or-later | header-later | gnu | gnu general public license<far> either version 2 of the license <option>
gpl-3-or-later | header-later | gnu | gnu general public license<far> either version 3 of the license <option>
gpl-2 | header | gnu | gnu general public license version 2 as published by the free software foundation
gpl-3 | header | gnu | gnu general public license version 3 as published by the free software foundation
gpl-1-or-later | version-later | gnu | gnu (?:general public license|gpl) <v>1(?: 0)? <later>
gpl-2-or-later | version-later | gnu | gnu (?:general public license|gpl) <v>2(?: 0)? <later>
gpl-3-or-later | version-later | gnu | gnu (?:general public license|gpl) <v>3(?: 0)? <later>
gpl-1 | version | gnu | gnu (?:general public license|gpl) <v>1(?: 0)?(?: only)?
gpl-2 | version | gnu | gnu (?:general public license|gpl) <v>2(?: 0)?(?: only)?
gpl-3 | version | gnu | gnu (?:general public license|gpl) <v>3(?: 0)?(?: only)?
gpl-2-or-later | version-later | version | version 2 <later> of the gnu general public license
gpl-3-or-later | version-later | version | version 3 <later> of the gnu general public license
gpl-2 | version | version | version 2 of the (?:gnu general public license|gnu gpl|gpl)
gpl-3 | version | version | version 3 of the (?:gnu general public license|gnu gpl|gpl)
gpl-2-or-later | short-later | gpl | gpl ?<v>2(?: 0)? <later>
gpl-3-or-later | short-later | gpl | gpl ?<v>3(?: 0)? <later>
gpl-1 | short | gpl | gpl ?(?:v ?|version )1(?: 0)?
gpl-2 | short | gpl | gpl ?(?:<v>2 0|v ?2|version 2)(?: only| licen[sc]e)?
gpl-3 | short | gpl | gpl ?(?:<v>3 0|v ?3|version 3)(?: only| licen[sc]e)?
gpl-2 | url | gnu | gnu org licenses (?:old licenses )?gpl 2 0(?: (?:html|txt))?
gpl-3 | url | gnu | gnu org licenses gpl 3 0(?: (?:html|txt))?
gpl | url | gnu | gnu org (?:licenses|copyleft) gpl(?: (?:html|txt))?
gpl | grant | gnu | <under>gnu (?:general public license|gpl)<bare>
gpl | grant | gpl | <under>gpl(?: licen[sc]e)?<bare>
gpl | name | gnu | gnu (?:general public <lic>|gpl)
gpl | hint | gpl | gpl <lic>
# GNU Lesser General Public License
lgpl-2-or-later | spdx-later | lgpl | <id> lgpl 2 0 or later
lgpl-2.1-or-later | spdx-later | lgpl | <id> lgpl 2 1 or later
lgpl-3-or-later | spdx-later | lgpl | <id> lgpl 3 0 or later
lgpl-2 | spdx | lgpl | <id> lgpl 2 0(?: only)?
lgpl-2.1 | spdx | lgpl | <id> lgpl 2 1(?: only)?
lgpl-3 | spdx | lgpl | <id> lgpl 3 0(?: only)?
lgpl-2-or-later | header-later | gnu | gnu (?:lesser|library) general public license<far> either version 2 of the license <option>
lgpl-2.1-or-later | header-later | gnu | gnu lesser general public license<far> either version 2 1 of the license <option>
lgpl-3-or-later | header-later | gnu | gnu lesser general public license<far> either version 3 of the license <option>
lgpl-2-or-later | version-later | gnu | gnu (?:(?:lesser|library) general public license|lgpl) <v>2(?: 0)? <later>
lgpl-2.1-or-later | version-later | gnu | gnu (?:(?:lesser|library) general public license|lgpl) <v>2 1 <later>
lgpl-3-or-later | version-later | gnu | gnu (?:lesser general public license|lgpl) <v>3(?: 0)? <later>
lgpl-2 | version | gnu | gnu (?:(?:lesser|library) general public license|lgpl) <v>2(?: 0)?(?: only)?
lgpl-2.1 | version | gnu | gnu (?:(?:lesser|library) general public license|lgpl) <v>2 1(?: only)?
lgpl-3 | version | gnu | gnu (?:lesser general public license|lgpl) <v>3(?: 0)?(?: only)?
lgpl-2.1-or-later | short-later | lgpl | lgpl ?<v>2 1 <later>
lgpl-3-or-later | short-later | lgpl | lgpl ?<v>3(?: 0)? <later>
lgpl-2.1 | short | lgpl | lgpl ?<v>2 1(?: only)?
lgpl-3 | short | lgpl | lgpl ?(?:<v>3 0|v ?3|version 3)(?: only)?
lgpl | url | gnu | gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: (?:2 1|3 0))?(?: (?:html|txt))?
lgpl | grant | gnu | <under>gnu (?:(?:lesser|library) general public license|lgpl)<bare>
lgpl | grant | lgpl | <under>lgpl<bare>
lgpl | name | gnu | gnu (?:(?:lesser|library) general public <lic>|lgpl)
lgpl | hint | lgpl | lgpl <lic>
# GNU Affero General Public License and GNU Free Documentation License
agpl-3-or-later | spdx-later | agpl | <id> agpl 3 0 or later
agpl-3 | spdx | agpl | <id> agpl 3 0(?: only)?
agpl-1 | spdx | agpl | <id> agpl 1 0(?: only| or later)?
agpl-3-or-later | header-later | gnu | gnu affero general public license<far> either version 3 of the license <option>
agpl-3-or-later | version-later | gnu | gnu (?:affero general public license|agpl) <v>3(?: 0)? <later>
agpl-3 | version | gnu | gnu (?:affero general public license|agpl) <v>3(?: 0)?(?: only)?
agpl-3-or-later | short-later | agpl | agpl ?<v>3(?: 0)? <later>
agpl-3 | short | agpl | agpl ?(?:<v>3 0|v ?3|version 3)(?: only)?
agpl-1 | version | affero | affero general public license <v>1(?: 0)?
agpl | url | gnu | gnu org licenses agpl(?: 3 0)?(?: (?:html|txt))?
agpl | grant | gnu | <under>gnu (?:affero general public license|agpl)<bare>
agpl | name | affero | (?:gnu )?affero (?:general public <lic>|gpl)
agpl | hint | agpl | agpl <lic>
gfdl-1.3-or-later | spdx-later | gfdl | <id> gfdl 1 3(?: invariants| no invariants)? or later
gfdl-1.3 | spdx | gfdl | <id> gfdl 1 3(?: invariants| no invariants)?(?: only)?
gfdl-1.2 | spdx | gfdl | <id> gfdl 1 2(?: invariants| no invariants)?(?: only| or later)?
gfdl-1.3-or-later | version-later | gnu | gnu (?:free documentation license|fdl) <v>1 3 <later>
gfdl-1.2-or-later | version-later | gnu | gnu (?:free documentation license|fdl) <v>1 2 <later>
gfdl-1.3 | version | gnu | gnu (?:free documentation license|fdl) <v>1 3
gfdl-1.2 | version | gnu | gnu (?:free documentation license|fdl) <v>1 2
gfdl-1.1 | version | gnu | gnu (?:free documentation license|fdl) <v>1 1
gfdl | name | gnu | gnu (?:free documentation <lic>|fdl)
# Apache
apache-2 | spdx | apache | <id> apache 2 0
apache-1.1 | spdx | apache | <id> apache 1 1
apache-1 | spdx | apache | <id> apache 1 0
apache-2-with-llvm-exception | spdx-later | apache | <id> apache 2 0 with llvm exception
apache-2 | url | apache | apache org licenses license 2 0(?: (?:html|txt))?
apache-1.1 | url | apache | apache org licenses license 1 1
apache-2 | header | apache | <under>apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | grant | apache | <under>apache (?:software )?license <v>2(?: 0)?
apache-2 | version | apache | apache (?:software )?<lic> <v>2(?: 0)?
apache-1.1 | version | apache | apache (?:software )?<lic> <v>1 1
apache-1 | version | apache | apache (?:software )?<lic> <v>1 0
apache-2 | short | apache | apache ?<v>2(?: 0)? (?:software )?<lic>
apache-2 | short | apache | apache ?(?:v ?2|version 2)(?: 0)?
apache-2 | short | asl | asl ?<v>2 0
apache-2 | short | al2 | al2 0
apache | grant | apache | <under>apache (?:software )?license<bare>
apache | name | apache | apache (?:software )?<lic>
# MIT and its kin
mit | spdx | mit | <id> mit
mit-0 | spdx-later | mit | <id> mit 0
mit | url | opensource | opensource org licen[sc]es? mit(?: license)?(?: (?:php|html))?
mit | url | mit | mit license org
mit | grant | mit | <under>mit(?: x11)? licen[sc]e
mit | grant | expat | <under>expat licen[sc]e
mit | text | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | text | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | text | software | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | short-later | mit | mit (?:0|no attribution) <lic>
mit | short | mit | mit x11 <lic>
mit | short | mit | mit style <lic>
mit | name | mit | mit <lic>
mit | name | expat | expat <lic>
x11 | spdx | x11 | <id> x11
x11 | name | x11 | x11 <lic>
isc | spdx | isc | <id> isc
isc | url | opensource | opensource org licen[sc]es? isc(?: license)?
isc | grant | isc | <under>isc licen[sc]e
isc | text | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | text | permission | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
isc | name | isc | isc <lic>
hpnd | text | permission | permission to use copy modify and distribute this software and its documentation for any purpose
# BSD
bsd-3-clause | spdx | bsd | <id> bsd 3 clause
bsd-2-clause | spdx | bsd | <id> bsd 2 clause
bsd-4-clause | spdx | bsd | <id> bsd 4 clause(?: uc)?
bsd-1-clause | spdx | bsd | <id> bsd 1 clause
bsd-0-clause | spdx | 0bsd | <id> 0bsd
bsd-3-clause-clear | spdx-later | bsd | <id> bsd 3 clause clear
bsd-2-clause-patent | spdx-later | bsd | <id> bsd 2 clause patent
bsd-3-clause | url | opensource | opensource org licen[sc]es? bsd 3 clause
bsd-2-clause | url | opensource | opensource org licen[sc]es? bsd 2 clause
bsd | url | opensource | opensource org licen[sc]es? bsd license(?: php)?
bsd-3-clause | version | bsd | (?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: <lic>)?
bsd-2-clause | version | bsd | (?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: <lic>)?
bsd-4-clause | version | bsd | (?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: <lic>)?
bsd-1-clause | version | bsd | (?:bsd (?:1|one) clause|(?:1|one) clause bsd)(?: <lic>)?
bsd-0-clause | version | bsd | (?:bsd (?:0|zero) clause|(?:0|zero) clause bsd)(?: <lic>)?
bsd-3-clause | short | bsd3 | bsd3
bsd-2-clause | short | bsd2 | bsd2
bsd-3-clause | version | bsd | (?:new|modified|revised) bsd <lic>
bsd-2-clause | version | simplified | simplified bsd <lic>
bsd-2-clause | version | freebsd | freebsd <lic>
bsd-4-clause | version | original | original bsd <lic>
bsd | grant | bsd | <under>bsd(?: style)? licen[sc]e
bsd | text | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | text | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | text | advertising | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd | name | bsd | bsd (?:style )?<lic>
# Creative Commons
cc0-1.0 | spdx | cc0 | <id> cc0 1 0
cc-by-4.0 | spdx | cc | <id> cc by 4 0
cc-by-3.0 | spdx | cc | <id> cc by 3 0
cc-by-sa-4.0 | spdx | cc | <id> cc by sa 4 0
cc-by-sa-3.0 | spdx | cc | <id> cc by sa 3 0
cc-by-nc-4.0 | spdx | cc | <id> cc by nc 4 0
cc-by-nc-sa-4.0 | spdx | cc | <id> cc by nc sa 4 0
cc-by-nc-nd-4.0 | spdx | cc | <id> cc by nc nd 4 0
cc-by-nd-4.0 | spdx | cc | <id> cc by nd 4 0
cc0-1.0 | url | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | url | creativecommons | creativecommons org (?:publicdomain mark 1 0|licenses publicdomain)
cc-by-4.0 | url | creativecommons | creativecommons org licenses by 4 0
cc-by-3.0 | url | creativecommons | creativecommons org licenses by 3 0
cc-by-2.5 | url | creativecommons | creativecommons org licenses by 2 5
cc-by-2.0 | url | creativecommons | creativecommons org licenses by 2 0
cc-by-sa-4.0 | url | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | url | creativecommons | creativecommons org licenses by sa 3 0
cc-by-sa-2.5 | url | creativecommons | creativecommons org licenses by sa 2 5
cc-by-nc-4.0 | url | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-3.0 | url | creativecommons | creativecommons org licenses by nc 3 0
cc-by-nc-sa-4.0 | url | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 | url | creativecommons | creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4.0 | url | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0 | url | creativecommons | creativecommons org licenses by nc nd 3 0
cc-by-nd-4.0 | url | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nd-3.0 | url | creativecommons | creativecommons org licenses by nd 3 0
cc-by-nc-sa-4.0 | version | cc | cc by nc sa 4 0
cc-by-nc-sa-3.0 | version | cc | cc by nc sa 3 0
cc-by-nc-sa-2.5 | version | cc | cc by nc sa 2 5
cc-by-nc-sa-2.0 | version | cc | cc by nc sa 2 0
cc-by-nc-nd-4.0 | version | cc | cc by nc nd 4 0
cc-by-nc-nd-3.0 | version | cc | cc by nc nd 3 0
cc-by-nc-4.0 | version | cc | cc by nc 4 0
cc-by-nc-3.0 | version | cc | cc by nc 3 0
cc-by-nc-2.0 | version | cc | cc by nc 2 0
cc-by-sa-4.0 | version | cc | cc by sa 4 0
cc-by-sa-3.0 | version | cc | cc by sa 3 0
cc-by-sa-2.5 | version | cc | cc by sa 2 5
cc-by-sa-2.0 | version | cc | cc by sa 2 0
cc-by-nd-4.0 | version | cc | cc by nd 4 0
cc-by-nd-3.0 | version | cc | cc by nd 3 0
cc-by-4.0 | version | cc | cc by 4 0
cc-by-3.0 | version | cc | cc by 3 0
cc-by-2.5 | version | cc | cc by 2 5
cc-by-2.0 | version | cc | cc by 2 0
cc-by-nc-sa | short | cc | cc by nc sa
cc-by-nc-nd | short | cc | cc by nc nd
cc-by-nc | name | cc | cc by nc
cc-by-sa | name | cc | cc by sa
cc-by-nd | name | cc | cc by nd
cc-by | hint | cc | cc by (?:<lic>|only)
cc-by-nc-sa-4.0 | version | creative | creative commons attribution non ?commercial share ?alike(?: international)? 4 0(?: international)?(?: public)?(?: <lic>)?
cc-by-nc-sa-3.0 | version | creative | creative commons attribution non ?commercial share ?alike 3 0(?: unported)?(?: <lic>)?
cc-by-nc-nd-4.0 | version | creative | creative commons attribution non ?commercial no ?deriv(?:atives|s)? 4 0(?: international)?(?: public)?(?: <lic>)?
cc-by-nc-nd-3.0 | version | creative | creative commons attribution non ?commercial no ?deriv(?:atives|s)? 3 0(?: unported)?(?: <lic>)?
cc-by-nc-4.0 | version | creative | creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: <lic>)?
cc-by-nc-3.0 | version | creative | creative commons attribution non ?commercial 3 0(?: unported)?(?: <lic>)?
cc-by-sa-4.0 | version | creative | creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: <lic>)?
cc-by-sa-3.0 | version | creative | creative commons attribution share ?alike 3 0(?: unported)?(?: <lic>)?
cc-by-nd-4.0 | version | creative | creative commons attribution no ?deriv(?:atives|s)? 4 0(?: international)?(?: public)?(?: <lic>)?
cc-by-4.0 | version | creative | creative commons attribution 4 0(?: international)?(?: public)?(?: <lic>)?
cc-by-3.0 | version | creative | creative commons attribution 3 0(?: unported)?(?: <lic>)?
cc-by-2.0 | version | creative | creative commons attribution 2 0(?: generic)?(?: <lic>)?
cc-by-nc-sa | short | creative | creative commons attribution non ?commercial share ?alike(?: <lic>)?
cc-by-nc-nd | short | creative | creative commons attribution non ?commercial no ?deriv(?:atives|s)?(?: <lic>)?
cc-by-nc | name | creative | creative commons attribution non ?commercial(?: <lic>)?
cc-by-sa | name | creative | creative commons attribution share ?alike(?: <lic>)?
cc-by-nd | name | creative | creative commons attribution no ?deriv(?:atives|s)?(?: <lic>)?
cc-by | hint | creative | creative commons attribution(?: <lic>)?
cc | hint | creative | creative commons <lic>
cc0-1.0 | version | cc0 | cc0 1 0(?: universal)?(?: public domain dedication)?
cc0-1.0 | short | creative | creative commons zero(?: <v>1 0)?(?: universal)?
cc0 | name | cc0 | cc0(?: <lic>)?
# Mozilla, Eclipse, and other weak copyleft
mpl-2.0 | spdx | mpl | <id> mpl 2 0(?: no copyleft exception)?
mpl-1.1 | spdx | mpl | <id> mpl 1 1
mpl-1.0 | spdx | mpl | <id> mpl 1 0
mpl-2.0 | header | mozilla | subject to the terms of the mozilla public license v 2 0
mpl-2.0 | url | mozilla | mozilla org mpl 2 0
mpl-2.0 | version | mozilla | mozilla public <lic> <v>2(?: 0)?
mpl-1.1 | version | mozilla | mozilla public <lic> <v>1 1
mpl-1.0 | version | mozilla | mozilla public <lic> <v>1 0
mpl-2.0 | short | mpl | mpl ?<v>2(?: 0)?
mpl-1.1 | short | mpl | mpl ?<v>1 1
mpl | name | mozilla | mozilla public <lic>
epl-2.0 | spdx | epl | <id> epl 2 0
epl-1.0 | spdx | epl | <id> epl 1 0
epl-2.0 | url | eclipse | eclipse org legal epl (?:2 0|v20)(?: html)?
epl-1.0 | url | eclipse | eclipse org legal epl v10(?: html)?
epl-2.0 | version | eclipse | eclipse public <lic> <v>2(?: 0)?
epl-1.0 | version | eclipse | eclipse public <lic> <v>1(?: 0)?
epl | name | eclipse | eclipse public <lic>
edl-1.0 | version | eclipse | eclipse distribution <lic> <v>1 0
cddl-1.0 | spdx | cddl | <id> cddl 1 0
cddl-1.1 | spdx | cddl | <id> cddl 1 1
cddl-1.0 | version | common | common development and distribution <lic> <v>1 0
cddl-1.1 | version | common | common development and distribution <lic> <v>1 1
cddl | name | common | common development and distribution <lic>
cddl | hint | cddl | cddl(?: <v>1 [01])?
cpl-1.0 | version | common | common public <lic> <v>1 0
cpl | name | common | common public <lic>
ipl-1.0 | version | ibm | ibm public <lic> <v>1 0
eupl-1.2 | spdx | eupl | <id> eupl 1 2
eupl-1.1 | spdx | eupl | <id> eupl 1 1
eupl-1.2 | version | european | european union public <lic> <v>1 2
eupl-1.1 | version | european | european union public <lic> <v>1 1
eupl | name | european | european union public <lic>
eupl | hint | eupl | eupl(?: <v>1 [012])?
osl-3.0 | spdx | osl | <id> osl 3 0
osl-3.0 | version | open | open software <lic> <v>3 0
osl | name | open | open software <lic>
afl-3.0 | spdx | afl | <id> afl 3 0
afl-3.0 | version | academic | academic free <lic> <v>3 0
afl | name | academic | academic free <lic>
artistic-2.0 | spdx | artistic | <id> artistic 2 0
artistic-2.0 | version | artistic | artistic <lic> <v>2(?: 0)?
artistic-1.0 | version | artistic | artistic <lic> <v>1(?: 0)?
artistic | name | artistic | artistic <lic>
perl | grant | perl | under the same terms as perl(?: itself)?
ms-pl | spdx | ms | <id> ms pl
ms-rl | spdx | ms | <id> ms rl
ms-pl | name | microsoft | microsoft public <lic>
ms-rl | name | microsoft | microsoft reciprocal <lic>
cecill-2.1 | version | cecill | cecill(?: free software <lic>)? <v>2 1
cecill | name | cecill | cecill(?: (?:b|c))?(?: free software)?(?: <lic>)?
# Other permissive ones
boost-1.0 | spdx | bsl | <id> bsl 1 0
boost-1.0 | url | boost | boost org license 1 0 txt
boost-1.0 | version | boost | boost software <lic> <v>1 0
boost | name | boost | boost software <lic>
zlib | spdx | zlib | <id> zlib
zlib | text | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | text | express | this software is provided as is without any express or implied warranty in no event
zlib | name | zlib | zlib(?: libpng)? <lic>
libpng | name | libpng | libpng <lic>
unlicense | spdx | unlicense | <id> unlicense
unlicense | url | unlicense | unlicense org
unlicense | text | unencumbered | this is free and unencumbered software released into the public domain
unlicense | name | unlicense | the unlicense
wtfpl-2 | spdx | wtfpl | <id> wtfpl
wtfpl-2 | version | fuck | do what the fuck you want to public license <v>2
wtfpl | name | fuck | do what the fuck you want to public license
wtfpl | hint | wtfpl | wtfpl
python-2 | spdx | spdx | <id> (?:python 2 0|psf 2 0)
python | name | python | python software foundation <lic>(?: <v>2)?
php-3.01 | spdx | php | <id> php 3 01
php-3.01 | version | php | php <lic> <v>3 01
php-3.0 | version | php | php <lic> <v>3 0
php | name | php | php <lic>
ruby | grant | ruby | under the same terms as ruby
ruby | name | ruby | ruby <lic>
postgresql | spdx | postgresql | <id> postgresql
postgresql | name | postgresql | postgresql <lic>
openssl | name | openssl | openssl <lic>
curl | name | curl | curl <lic>
ncsa | name | ncsa | (?:university of illinois )?ncsa open source <lic>
upl-1.0 | version | universal | universal permissive <lic>(?: <v>1 0)?
bluoak-1.0.0 | version | blue | blue oak model <lic>(?: 1 0 0)?
mulanpsl-2 | version | mulan | mulan (?:psl|permissive software <lic>) ?<v>2
w3c | name | w3c | w3c (?:software )?(?:notice and )?<lic>
beerware | text | beer | the beer ware <lic>
ofl-1.1 | spdx | ofl | <id> ofl 1 1(?: (?:no )?rfn)?
ofl-1.1 | url | scripts | scripts sil org ofl
ofl-1.1 | version | sil | sil open font <lic> <v>1 1
ofl-1.0 | version | sil | sil open font <lic> <v>1 0
ofl | name | open | open font <lic>
# Data, models, and source that is not open
odbl-1.0 | spdx | odbl | <id> odbl 1 0
odbl-1.0 | url | opendatacommons | opendatacommons org licenses odbl(?: 1 0)?
odc-by-1.0 | url | opendatacommons | opendatacommons org licenses by(?: 1 0)?
pddl-1.0 | url | opendatacommons | opendatacommons org licenses pddl(?: 1 0)?
odbl-1.0 | version | open | open (?:data commons open )?database <lic> <v>1 0
odbl | name | open | open database <lic>
odc-by | name | open | open data commons attribution <lic>
cdla-permissive | name | community | community data license agreement permissive(?: <v>[12] 0)?
cdla-sharing | name | community | community data license agreement sharing(?: <v>1 0)?
llama-3 | version | llama | llama 3(?: [123])? community <lic>
llama-2 | version | llama | llama 2 community <lic>
llama | name | llama | llama community <lic>
openrail | version | creativeml | creativeml open rail(?: m)? <lic>
openrail | name | rail | (?:bigscience |bigcode )?open rail(?: m)? <lic>
openrail | name | openrail | (?:bigscience |bigcode )?openrail(?: m)? <lic>
gemma | name | gemma | gemma terms of use
busl-1.1 | spdx | busl | <id> busl 1 1
busl-1.1 | version | business | business source <lic>(?: <v>1 1)?
elastic-2.0 | spdx | elastic | <id> elastic 2 0
elastic-2.0 | version | elastic | elastic <lic> <v>2 0
elastic | name | elastic | elastic <lic>
sspl-1.0 | spdx | sspl | <id> sspl 1 0
sspl-1.0 | version | server | server side public <lic>(?: <v>1(?: 0)?)?
commons-clause | name | commons | commons clause license condition(?: <v>1 0)?
polyform-noncommercial | name | polyform | polyform noncommercial <lic>(?: 1 0 0)?
json | text | evil | the software shall be used for good not evil
public-domain | text | domain | (?:released into|dedicated to|placed in|placed into) the public domain
public-domain | hint | domain | (?:is|are) in the public domain
ogl-uk-3.0 | version | open | open government <lic> <v>3 0
ogl-uk | name | open | open government <lic>
all-rights-reserved | hint | reserved | all rights reserved
proprietary | text | proprietary | proprietary and confidential
proprietary | text | confidential | (?:company )?confidential and proprietary
proprietary | text | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
"""
