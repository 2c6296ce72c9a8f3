"""Signature rules of the license scan, written by hand, in order.

A line is ``label priority confidence pattern``; a line that begins with ``=`` names the gate
words of the rules below it: a pattern's first word is one of them.  Patterns are regular
expressions over lower-case words joined by one space.  ``{x}`` stands for a fragment of
``FRAGMENTS``.  Priorities: 5 text of a license or its header, 4 a grant that names license and
version, 3 a license with its version, 2 a grant without a version, a tag or an address,
1 a mention.
"""

from __future__ import annotations

from functools import lru_cache
from re import _parser as parser

FRAGMENTS = {
    "L": "licen[cs]e",
    "v": " (?:version |v |ver )?v?",
    "later": "(?:(?: or)?(?: at your option)? any later(?: version)?| or later(?: version)?| or newer| only)?",
    "under": "(?:licensed|released|distributed|redistributed|published|available|covered|provided|offered) (?:only )?(?:under|by|with) (?:both )?(?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?",
}

RULES = r"""
= licensed released distributed redistributed published available covered provided offered
apache-2.0 5 1.0 {under}apache {L} version 2 0 the {L} you may not use this file except in compliance with the {L}
apache-2.0 4 1.0 {under}apache(?: software| public)? {L}{v}2(?: 0)?(?! \d)
apache-1.1 4 1.0 {under}apache(?: software)? {L}{v}1 1
apache-1.0 4 1.0 {under}apache(?: software)? {L}{v}1(?: 0)?(?! \d)
gpl-1.0 4 1.0 {under}(?:gnu )?(?:general public {L}|gpl){v}1(?: 0)?(?! \d){later}
gpl-2.0 4 1.0 {under}(?:gnu )?(?:general public {L}|gpl)(?: {L})?{v}2(?: 0)?(?! \d){later}
gpl-3.0 4 1.0 {under}(?:gnu )?(?:general public {L}|gpl)(?: {L})?{v}3(?: 0)?(?! \d){later}
lgpl-2.0 4 1.0 {under}(?:gnu )?(?:(?:lesser|library) general public {L}|lgpl)(?: {L})?{v}2(?: 0)?(?! \d){later}
lgpl-2.1 4 1.0 {under}(?:gnu )?(?:(?:lesser|library) general public {L}|lgpl)(?: {L})?{v}2 1{later}
lgpl-3.0 4 1.0 {under}(?:gnu )?(?:(?:lesser|library) general public {L}|lgpl)(?: {L})?{v}3(?: 0)?(?! \d){later}
agpl-3.0 4 1.0 {under}(?:gnu )?(?:affero general public {L}|agpl)(?: {L})?{v}3(?: 0)?(?! \d){later}
gfdl-1.1 4 1.0 {under}(?:gnu )?free documentation {L}{v}1 1{later}
gfdl-1.2 4 1.0 {under}(?:gnu )?free documentation {L}{v}1 2{later}
gfdl-1.3 4 1.0 {under}(?:gnu )?free documentation {L}{v}1 3{later}
mpl-1.0 4 1.0 {under}(?:mozilla public {L}|mpl){v}1(?: 0)?(?! \d){later}
mpl-1.1 4 1.0 {under}(?:mozilla public {L}|mpl){v}1 1{later}
mpl-2.0 4 1.0 {under}(?:mozilla public {L}|mpl){v}2(?: 0)?(?! \d){later}
epl-1.0 4 1.0 {under}(?:eclipse public {L}|epl){v}1(?: 0)?(?! \d)
epl-2.0 4 1.0 {under}(?:eclipse public {L}|epl){v}2(?: 0)?(?! \d)
eupl-1.1 4 1.0 {under}(?:european union public {L}|eupl){v}1 1
eupl-1.2 4 1.0 {under}(?:european union public {L}|eupl){v}1 2
cddl-1.0 4 1.0 {under}(?:common development and distribution(?: public)? {L}|cddl){v}1(?: 0)?(?! \d){later}
cddl-1.1 4 1.0 {under}(?:common development and distribution(?: public)? {L}|cddl){v}1 1{later}
artistic-1.0 4 1.0 {under}(?:perl )?artistic {L}{v}1(?: 0)?(?! \d)
artistic-2.0 4 1.0 {under}(?:perl )?artistic {L}{v}2(?: 0)?(?! \d)
bsl-1.0 4 1.0 {under}boost software {L}{v}1(?: 0)?(?! \d)
ofl-1.1 4 1.0 {under}sil open font {L}{v}1 1
odbl-1.0 4 1.0 {under}open (?:data commons open )?database {L}(?: odbl)?(?:{v}1(?: 0)?)?(?! \d)
cc-by-1.0 4 1.0 {under}(?:creative commons attribution|cc by)(?: \w+)?(?: public)?(?: {L})?{v}1 0
cc-by-2.0 4 1.0 {under}(?:creative commons attribution|cc by)(?: \w+)?(?: public)?(?: {L})?{v}2 0
cc-by-2.5 4 1.0 {under}(?:creative commons attribution|cc by)(?: \w+)?(?: public)?(?: {L})?{v}2 5
cc-by-3.0 4 1.0 {under}(?:creative commons attribution|cc by)(?: \w+)?(?: public)?(?: {L})?{v}3 0
cc-by-4.0 4 1.0 {under}(?:creative commons attribution|cc by)(?: \w+)?(?: public)?(?: {L})?{v}4 0
cc-by-sa-2.0 4 1.0 {under}(?:creative commons attribution share ?alike|cc by sa)(?: \w+)?(?: public)?(?: {L})?{v}2 0
cc-by-sa-2.5 4 1.0 {under}(?:creative commons attribution share ?alike|cc by sa)(?: \w+)?(?: public)?(?: {L})?{v}2 5
cc-by-sa-3.0 4 1.0 {under}(?:creative commons attribution share ?alike|cc by sa)(?: \w+)?(?: public)?(?: {L})?{v}3 0
cc-by-sa-4.0 4 1.0 {under}(?:creative commons attribution share ?alike|cc by sa)(?: \w+)?(?: public)?(?: {L})?{v}4 0
cc-by-nc-3.0 4 1.0 {under}(?:creative commons attribution non ?commercial|cc by nc)(?: \w+)?(?: public)?(?: {L})?{v}3 0
cc-by-nc-4.0 4 1.0 {under}(?:creative commons attribution non ?commercial|cc by nc)(?: \w+)?(?: public)?(?: {L})?{v}4 0
cc-by-nd-3.0 4 1.0 {under}(?:creative commons attribution no ?deriv(?:ative)?s?|cc by nd)(?: \w+)?(?: public)?(?: {L})?{v}3 0
cc-by-nd-4.0 4 1.0 {under}(?:creative commons attribution no ?deriv(?:ative)?s?|cc by nd)(?: \w+)?(?: public)?(?: {L})?{v}4 0
cc-by-nc-sa-3.0 4 1.0 {under}(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: \w+)?(?: public)?(?: {L})?{v}3 0
cc-by-nc-sa-4.0 4 1.0 {under}(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: \w+)?(?: public)?(?: {L})?{v}4 0
cc-by-nc-nd-3.0 4 1.0 {under}(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s?|cc by nc nd)(?: \w+)?(?: public)?(?: {L})?{v}3 0
cc-by-nc-nd-4.0 4 1.0 {under}(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s?|cc by nc nd)(?: \w+)?(?: public)?(?: {L})?{v}4 0
bsd-0-clause 4 1.0 {under}(?:0|zero) clause bsd(?: {L})?
bsd-1-clause 4 1.0 {under}(?:(?:1|one) clause bsd|bsd (?:1|one) clause)(?: {L})?
bsd-2-clause 4 1.0 {under}(?:(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd)(?: {L})?
bsd-3-clause 4 1.0 {under}(?:(?:3|three) clause bsd|bsd (?:3|three) clause|new bsd|modified bsd|revised bsd)(?: {L})?
bsd-4-clause 4 1.0 {under}(?:(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd)(?: {L})?
apache 2 0.8 {under}apache(?: software)? {L}
gpl 2 0.8 {under}(?:gnu general public {L}|gnu gpl|gpl)
lgpl 2 0.8 {under}(?:gnu (?:lesser|library) general public {L}|gnu lgpl|lgpl)
agpl 2 0.8 {under}(?:gnu affero general public {L}|gnu agpl|agpl)
gfdl 2 0.8 {under}(?:gnu free documentation {L}|gnu fdl|gfdl)
mpl 2 0.8 {under}(?:mozilla public {L}|mpl)
epl 2 0.8 {under}(?:eclipse public {L}|epl)
eupl 2 0.8 {under}(?:european union public {L}|eupl)
cddl 2 0.8 {under}(?:common development and distribution(?: public)? {L}|cddl)
mit 2 0.9 {under}(?:mit|expat|x11)(?: style| open source)? {L}
bsd 2 0.7 {under}bsd(?: style| open source)? {L}
isc 2 0.9 {under}isc {L}
zlib 2 0.9 {under}(?:zlib|zlib libpng|libpng) {L}
wtfpl 2 0.9 {under}(?:wtfpl|do what the fuck you want to public {L})
unlicense 2 0.9 {under}unlicense
php 2 0.8 {under}php {L}
psf 2 0.8 {under}(?:python software foundation|psf) {L}
ruby 2 0.8 {under}ruby {L}
perl 2 0.7 {under}same terms as perl(?: itself)?
artistic 2 0.8 {under}(?:perl )?artistic {L}
cc-by-sa 2 0.8 {under}(?:creative commons attribution share ?alike|cc by sa)(?: {L})?
cc-by-nc 2 0.8 {under}(?:creative commons attribution non ?commercial|cc by nc)(?: {L})?
cc-by-nd 2 0.8 {under}(?:creative commons attribution no ?deriv(?:ative)?s?|cc by nd)(?: {L})?
cc-by 2 0.8 {under}(?:creative commons attribution|cc by)(?: {L})?
cc 2 0.5 {under}creative commons(?: {L})?
ms-pl 2 0.8 {under}microsoft public {L}
warranty-disclaimer 1 0.3 provided as is (?:and )?without (?:any )?(?:express or implied )?(?:warranty|warranties)
warranty-disclaimer 1 0.3 provided by the copyright holders and contributors as is and any express or implied warranties

= free
gpl-2.0 5 1.0 free software you can redistribute it and or modify it under the terms of the gnu general public {L}(?: as published by the free software foundation)? either version 2 of the {L}(?: or at your option any later version)?
gpl-3.0 5 1.0 free software you can redistribute it and or modify it under the terms of the gnu general public {L}(?: as published by the free software foundation)? either version 3 of the {L}(?: or at your option any later version)?
lgpl-2.1 5 1.0 free software you can redistribute it and or modify it under the terms of the gnu lesser general public {L}(?: as published by the free software foundation)? either version 2 1 of the {L}(?: or at your option any later version)?
lgpl-3.0 5 1.0 free software you can redistribute it and or modify it under the terms of the gnu lesser general public {L}(?: as published by the free software foundation)? either version 3 of the {L}(?: or at your option any later version)?
agpl-3.0 5 1.0 free software you can redistribute it and or modify it under the terms of the gnu affero general public {L}(?: as published by the free software foundation)? either version 3 of the {L}(?: or at your option any later version)?
gpl 5 0.9 free software you can redistribute it and or modify it under the terms of the gnu general public {L}
lgpl 5 0.9 free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public {L}
perl 5 0.9 free software you can redistribute it and or modify it under the same terms as perl
unlicense 5 1.0 free and unencumbered software released into the public domain

= permission
mit 5 1.0 permission is hereby granted free of charge to any person obtaining a copy
ofl-1.1 5 1.0 permission is hereby granted free of charge to any person obtaining a copy of the font software
bsl-1.0 5 1.0 permission is hereby granted free of charge to any person or organization obtaining a copy
isc 5 1.0 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 5 0.9 permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
hpnd 5 0.9 permission to use copy modify and distribute this software and its documentation for any purpose
gfdl 5 0.9 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {L}
zlib 5 0.9 permission is granted to anyone to use this software for any purpose including commercial applications
permission-notice 1 0.4 permission notice shall be (?:included|preserved) in all copies

= redistribution redistributions
bsd 5 0.9 redistribution and use in source and binary forms with or without modification
bsd 5 0.8 redistributions of source code must retain the (?:above|accompanying) copyright notice
bsd 5 0.8 redistributions in binary form must reproduce the above copyright notice

= neither
bsd-3-clause 5 0.9 neither the names? of (?:\w+ ){{1,8}}?(?:nor the names of its|or its) contributors may be used to endorse or promote products

= origin
zlib 5 0.9 origin of this software must not be misrepresented

= altered
zlib 5 0.8 altered source versions must be plainly marked as such

= unless
apache-2.0 5 0.9 unless required by applicable law or agreed to in writing software distributed under the {L} is distributed on an as is basis

= advertising
bsd-4-clause 5 0.8 advertising materials mentioning features or use of this software must display the following acknowledgement

= spdx
gpl-1.0 4 1.0 spdx {L} identifier gpl 1 0(?: only| or later)?
gpl-2.0 4 1.0 spdx {L} identifier gpl 2 0(?: only| or later)?
gpl-3.0 4 1.0 spdx {L} identifier gpl 3 0(?: only| or later)?
lgpl-2.0 4 1.0 spdx {L} identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 4 1.0 spdx {L} identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 4 1.0 spdx {L} identifier lgpl 3 0(?: only| or later)?
agpl-3.0 4 1.0 spdx {L} identifier agpl 3 0(?: only| or later)?
apache-2.0 4 1.0 spdx {L} identifier apache 2 0
mit 4 1.0 spdx {L} identifier (?:mit|mit 0)
bsd-2-clause 4 1.0 spdx {L} identifier bsd 2 clause(?: patent)?
bsd-3-clause 4 1.0 spdx {L} identifier bsd 3 clause(?: clear)?
bsd-0-clause 4 1.0 spdx {L} identifier (?:0bsd|bsd 0 clause)
isc 4 1.0 spdx {L} identifier isc
zlib 4 1.0 spdx {L} identifier zlib
mpl-1.1 4 1.0 spdx {L} identifier mpl 1 1
mpl-2.0 4 1.0 spdx {L} identifier mpl 2 0
epl-1.0 4 1.0 spdx {L} identifier epl 1 0
epl-2.0 4 1.0 spdx {L} identifier epl 2 0
eupl-1.2 4 1.0 spdx {L} identifier eupl 1 2
cddl-1.0 4 1.0 spdx {L} identifier cddl 1 0
bsl-1.0 4 1.0 spdx {L} identifier bsl 1 0
unlicense 4 1.0 spdx {L} identifier unlicense
wtfpl 4 1.0 spdx {L} identifier wtfpl
cc0-1.0 4 1.0 spdx {L} identifier cc0 1 0
cc-by-4.0 4 1.0 spdx {L} identifier cc by 4 0
cc-by-sa-4.0 4 1.0 spdx {L} identifier cc by sa 4 0
ofl-1.1 4 1.0 spdx {L} identifier ofl 1 1
artistic-2.0 4 1.0 spdx {L} identifier artistic 2 0

= opensource
mit 2 0.9 opensource org licenses mit(?: {L})?
isc 2 0.9 opensource org licenses isc(?: {L})?
apache-2.0 2 0.9 opensource org licenses apache 2 0
bsd-2-clause 2 0.9 opensource org licenses bsd 2 clause
bsd-3-clause 2 0.9 opensource org licenses bsd 3 clause
bsd 2 0.7 opensource org licenses bsd {L}
gpl-2.0 2 0.9 opensource org licenses gpl 2 0
gpl-3.0 2 0.9 opensource org licenses gpl 3 0
mpl-2.0 2 0.9 opensource org licenses mpl 2 0
zlib 2 0.9 opensource org licenses zlib

= creativecommons
cc0-1.0 2 0.9 creativecommons org publicdomain zero 1 0
public-domain 2 0.7 creativecommons org publicdomain mark 1 0
cc-by-2.0 2 0.9 creativecommons org licenses by 2 0
cc-by-2.5 2 0.9 creativecommons org licenses by 2 5
cc-by-3.0 2 0.9 creativecommons org licenses by 3 0
cc-by-4.0 2 0.9 creativecommons org licenses by 4 0
cc-by-sa-2.5 2 0.9 creativecommons org licenses by sa 2 5
cc-by-sa-3.0 2 0.9 creativecommons org licenses by sa 3 0
cc-by-sa-4.0 2 0.9 creativecommons org licenses by sa 4 0
cc-by-nc-3.0 2 0.9 creativecommons org licenses by nc 3 0
cc-by-nc-4.0 2 0.9 creativecommons org licenses by nc 4 0
cc-by-nd-4.0 2 0.9 creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0 2 0.9 creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 2 0.9 creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 2 0.9 creativecommons org licenses by nc nd 4 0

= gnu
gpl-2.0 2 0.9 gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 2 0.9 gnu org licenses gpl 3 0
lgpl-2.1 2 0.9 gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 2 0.9 gnu org licenses lgpl 3 0
agpl-3.0 2 0.9 gnu org licenses agpl 3 0
gpl 2 0.7 gnu org licenses gpl
gpl-1.0 3 0.9 gnu (?:general public {L}|gpl){v}1(?: 0)?(?! \d){later}
gpl-2.0 3 0.9 gnu (?:general public {L}|gpl)(?: {L})?{v}2(?: 0)?(?! \d){later}
gpl-3.0 3 0.9 gnu (?:general public {L}|gpl)(?: {L})?{v}3(?: 0)?(?! \d){later}
lgpl-2.0 3 0.9 gnu (?:(?:lesser|library) general public {L}|lgpl)(?: {L})?{v}2(?: 0)?(?! \d){later}
lgpl-2.1 3 0.9 gnu (?:(?:lesser|library) general public {L}|lgpl)(?: {L})?{v}2 1{later}
lgpl-3.0 3 0.9 gnu (?:(?:lesser|library) general public {L}|lgpl)(?: {L})?{v}3(?: 0)?(?! \d){later}
agpl-3.0 3 0.9 gnu (?:affero general public {L}|agpl)(?: {L})?{v}3(?: 0)?(?! \d){later}
gfdl-1.1 3 0.9 gnu (?:free documentation {L}|fdl){v}1 1{later}
gfdl-1.2 3 0.9 gnu (?:free documentation {L}|fdl){v}1 2{later}
gfdl-1.3 3 0.9 gnu (?:free documentation {L}|fdl){v}1 3{later}
gpl 1 0.6 gnu (?:general public {L}|gpl)
lgpl 1 0.6 gnu (?:(?:lesser|library) general public {L}|lgpl)
agpl 1 0.6 gnu (?:affero general public {L}|agpl)
gfdl 1 0.6 gnu (?:free documentation {L}|fdl)

= gpl gplv1 gplv2 gplv3 gpl2 gpl3
gpl-1.0 3 0.9 gpl(?: {L})?(?:{v}1(?: 0)?(?! \d)|v1){later}
gpl-2.0 3 0.9 gpl(?: {L})?(?:{v}2(?: 0)?(?! \d)|v?2){later}
gpl-3.0 3 0.9 gpl(?: {L})?(?:{v}3(?: 0)?(?! \d)|v?3){later}
gpl 1 0.6 gpl {L}

= lgpl lgplv2 lgplv3 lgpl2 lgpl3
lgpl-2.1 3 0.9 lgpl(?: {L})?(?:{v}2 1|v?2 1){later}
lgpl-2.0 3 0.85 lgpl(?: {L})?(?:{v}2(?: 0)?(?! \d)|v?2(?! \d)){later}
lgpl-3.0 3 0.9 lgpl(?: {L})?(?:{v}3(?: 0)?(?! \d)|v?3){later}
lgpl 1 0.6 lgpl(?: {L})?

= agpl agplv3 agpl3
agpl-3.0 3 0.9 agpl(?: {L})?(?:{v}3(?: 0)?(?! \d)|v?3){later}
agpl 1 0.6 agpl(?: {L})?

= gfdl
gfdl-1.1 3 0.9 gfdl{v}1 1
gfdl-1.2 3 0.9 gfdl{v}1 2
gfdl-1.3 3 0.9 gfdl{v}1 3
gfdl 1 0.6 gfdl

= apache
apache-2.0 2 0.9 apache org licenses {L} 2 0
apache-2.0 3 0.9 apache(?: software| public)? {L}{v}2(?: 0)?(?! \d)
apache-2.0 3 0.9 apache{v}2 0(?: {L})?
apache-1.1 3 0.9 apache(?: software)? {L}{v}1 1
apache-1.0 3 0.9 apache(?: software)? {L}{v}1(?: 0)?(?! \d)
apache 1 0.6 apache(?: software)? {L}

= mozilla mpl
mpl-2.0 2 0.9 mozilla org mpl 2 0
mpl-1.0 3 0.9 (?:mozilla public {L}|mpl){v}1(?: 0)?(?! \d)
mpl-1.1 3 0.9 (?:mozilla public {L}|mpl){v}1 1
mpl-2.0 3 0.9 (?:mozilla public {L}|mpl){v}2(?: 0)?(?! \d)
mpl 1 0.6 mozilla public {L}

= eclipse epl
epl-2.0 2 0.9 eclipse org legal epl (?:2 0|v20)
epl-1.0 2 0.9 eclipse org legal epl v10
epl-1.0 3 0.9 (?:eclipse public {L}|epl){v}1(?: 0)?(?! \d)
epl-2.0 3 0.9 (?:eclipse public {L}|epl){v}2(?: 0)?(?! \d)
epl 1 0.6 eclipse public {L}

= european eupl
eupl-1.0 3 0.9 (?:european union public {L}|eupl){v}1 0
eupl-1.1 3 0.9 (?:european union public {L}|eupl){v}1 1
eupl-1.2 3 0.9 (?:european union public {L}|eupl){v}1 2
eupl 1 0.6 (?:european union public {L}|eupl)

= common cddl
cddl-1.0 3 0.9 (?:common development and distribution(?: public)? {L}|cddl){v}1(?: 0)?(?! \d)
cddl-1.1 3 0.9 (?:common development and distribution(?: public)? {L}|cddl){v}1 1
cddl 1 0.6 (?:common development and distribution(?: public)? {L}|cddl)
cpl-1.0 3 0.9 common public {L}{v}1(?: 0)?(?! \d)
cpal-1.0 3 0.9 common public attribution {L}{v}1(?: 0)?(?! \d)
cpl 1 0.6 common public {L}

= artistic
artistic-1.0 3 0.9 artistic {L}{v}1(?: 0)?(?! \d)
artistic-2.0 3 0.9 artistic {L}{v}2(?: 0)?(?! \d)
artistic 1 0.6 artistic {L}

= boost
bsl-1.0 2 0.9 boost org {L} 1 0
bsl-1.0 3 0.9 boost software {L}(?:{v}1(?: 0)?)?

= open
osl-1.0 3 0.9 open software {L}{v}1 0
osl-2.0 3 0.9 open software {L}{v}2 0
osl-2.1 3 0.9 open software {L}{v}2 1
osl-3.0 3 0.9 open software {L}{v}3 0
odbl-1.0 3 0.9 open (?:data commons open )?database {L}(?: odbl)?(?:{v}1(?: 0)?)?
osl 1 0.5 open software {L}
open-source 1 0.3 open source {L}

= academic
afl-2.1 3 0.9 academic free {L}{v}2 1
afl-3.0 3 0.9 academic free {L}{v}3 0
afl 1 0.6 academic free {L}

= zope zpl
zpl-2.0 3 0.9 (?:zope public {L}|zpl){v}2 0
zpl-2.1 3 0.9 (?:zope public {L}|zpl){v}2 1
zpl 1 0.6 zope public {L}

= python psf
psf-2.0 3 0.9 (?:python software foundation|psf) {L}{v}2(?: 0)?(?! \d)
psf 1 0.6 (?:python software foundation|python|psf) {L}

= php
php-3.0 3 0.9 php {L}{v}3 0
php-3.01 3 0.9 php {L}{v}3 01
php 1 0.6 php {L}

= latex lppl
lppl-1.3 3 0.9 (?:latex project public {L}|lppl){v}1 3[abc]?
lppl 1 0.6 (?:latex project public {L}|lppl)

= sil ofl
ofl-1.0 3 0.9 (?:sil open font {L}|ofl){v}1 0
ofl-1.1 3 0.9 (?:sil open font {L}|ofl){v}1 1
ofl 1 0.6 sil open font {L}

= microsoft ms
ms-pl 1 0.7 (?:microsoft public {L}|ms pl)
ms-rl 1 0.7 (?:microsoft reciprocal {L}|ms rl)

= cc cc0
cc0-1.0 3 0.9 cc ?0(?: {L})?(?:{v}1 0)?
cc-by-1.0 3 0.9 cc by{v}1 0
cc-by-2.0 3 0.9 cc by{v}2 0
cc-by-2.5 3 0.9 cc by{v}2 5
cc-by-3.0 3 0.9 cc by{v}3 0
cc-by-4.0 3 0.9 cc by{v}4 0
cc-by-sa-2.0 3 0.9 cc by sa{v}2 0
cc-by-sa-2.5 3 0.9 cc by sa{v}2 5
cc-by-sa-3.0 3 0.9 cc by sa{v}3 0
cc-by-sa-4.0 3 0.9 cc by sa{v}4 0
cc-by-nc-2.0 3 0.9 cc by nc{v}2 0
cc-by-nc-3.0 3 0.9 cc by nc{v}3 0
cc-by-nc-4.0 3 0.9 cc by nc{v}4 0
cc-by-nd-3.0 3 0.9 cc by nd{v}3 0
cc-by-nd-4.0 3 0.9 cc by nd{v}4 0
cc-by-nc-sa-3.0 3 0.9 cc by nc sa{v}3 0
cc-by-nc-sa-4.0 3 0.9 cc by nc sa{v}4 0
cc-by-nc-nd-3.0 3 0.9 cc by nc nd{v}3 0
cc-by-nc-nd-4.0 3 0.9 cc by nc nd{v}4 0
cc-by-nc-sa 1 0.6 cc by nc sa
cc-by-nc-nd 1 0.6 cc by nc nd
cc-by-sa 1 0.6 cc by sa
cc-by-nc 1 0.6 cc by nc
cc-by-nd 1 0.6 cc by nd
cc-by 1 0.6 cc by

= creative
cc0-1.0 3 0.9 creative commons (?:zero|cc0|0)(?: \w+)?(?:{v}1 0)?
cc-by-2.5 3 0.9 creative commons attribution(?: \w+)?(?: public)?(?: {L})?{v}2 5
cc-by-3.0 3 0.9 creative commons attribution(?: \w+)?(?: public)?(?: {L})?{v}3 0
cc-by-4.0 3 0.9 creative commons attribution(?: \w+)?(?: public)?(?: {L})?{v}4 0
cc-by-sa-2.5 3 0.9 creative commons attribution share ?alike(?: \w+)?(?: public)?(?: {L})?{v}2 5
cc-by-sa-3.0 3 0.9 creative commons attribution share ?alike(?: \w+)?(?: public)?(?: {L})?{v}3 0
cc-by-sa-4.0 3 0.9 creative commons attribution share ?alike(?: \w+)?(?: public)?(?: {L})?{v}4 0
cc-by-nc-3.0 3 0.9 creative commons attribution non ?commercial(?: \w+)?(?: public)?(?: {L})?{v}3 0
cc-by-nc-4.0 3 0.9 creative commons attribution non ?commercial(?: \w+)?(?: public)?(?: {L})?{v}4 0
cc-by-nd-4.0 3 0.9 creative commons attribution no ?deriv(?:ative)?s?(?: \w+)?(?: public)?(?: {L})?{v}4 0
cc-by-nc-sa-4.0 3 0.9 creative commons attribution non ?commercial share ?alike(?: \w+)?(?: public)?(?: {L})?{v}4 0
cc-by-nc-nd-4.0 3 0.9 creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: \w+)?(?: public)?(?: {L})?{v}4 0
cc-by-nc-sa 1 0.6 creative commons attribution non ?commercial share ?alike
cc-by-nc-nd 1 0.6 creative commons attribution non ?commercial no ?deriv(?:ative)?s?
cc-by-sa 1 0.6 creative commons attribution share ?alike
cc-by-nc 1 0.6 creative commons attribution non ?commercial
cc-by-nd 1 0.6 creative commons attribution no ?deriv(?:ative)?s?
cc-by 1 0.6 creative commons attribution
cc 1 0.4 creative commons {L}

= bsd freebsd
bsd-2-clause 3 0.9 freebsd {L}
bsd-0-clause 3 0.9 bsd (?:0|zero) clause(?: {L})?
bsd-1-clause 3 0.9 bsd (?:1|one) clause(?: {L})?
bsd-2-clause 3 0.9 bsd (?:2|two) clause(?: {L})?
bsd-3-clause 3 0.9 bsd (?:3|three) clause(?: {L})?
bsd-4-clause 3 0.9 bsd (?:4|four) clause(?: {L})?
bsd 1 0.6 bsd(?: style| type)? {L}

= 0 zero 1 one 2 two 3 three 4 four 0bsd
bsd-0-clause 3 0.9 (?:(?:0|zero) clause bsd|0bsd)(?: {L})?
bsd-1-clause 3 0.9 (?:1|one) clause bsd(?: {L})?
bsd-2-clause 3 0.9 (?:2|two) clause bsd(?: {L})?
bsd-3-clause 3 0.9 (?:3|three) clause bsd(?: {L})?
bsd-4-clause 3 0.9 (?:4|four) clause bsd(?: {L})?

= simplified new modified revised original
bsd-2-clause 3 0.85 simplified bsd(?: {L})?
bsd-3-clause 3 0.85 (?:new|modified|revised) bsd(?: {L})?
bsd-4-clause 3 0.85 original bsd(?: {L})?

= mit expat x11
mit 1 0.6 (?:mit|expat|x11)(?: x11| expat| style)? {L}

= isc
isc 1 0.6 isc {L}

= zlib libpng
zlib 1 0.6 (?:zlib|zlib libpng|libpng) {L}

= unlicense
unlicense 2 0.9 unlicense org
unlicense 1 0.7 unlicense(?: {L})?

= wtfpl do
wtfpl 1 0.8 (?:wtfpl|do what the fuck you want to public {L})

= public
public-domain 1 0.4 public domain

= all
all-rights-reserved 1 0.3 all rights reserved

= see
see-license 1 0.3 see (?:the )?(?:accompanying |included )?(?:file )?{L}(?: txt| md)?(?: file)? for (?:more )?(?:details|information|the full {L} text)

= dual
dual-license 1 0.4 dual licensed (?:under|with)
"""

#: Substrings of the joined words between two spaces, one of which every rule and base phrase holds.
KEYWORDS = (
    "licen", " gnu ", "gpl", " mpl ", " epl ", " eupl ", "cddl", "apache", "bsd", " cc by ", " cc 0 ", " cc0 ", "creative commons", "creativecommons", "gfdl", "lppl", " ofl ", " zpl ", "wtfpl",
    " ms pl ", " ms rl ", "public domain", "rights reserved", "permission is ", "permission to use", "permission notice", "redistribution", "same terms as perl", "provided as is",
    "contributors as is", "to endorse or promote", "must not be misrepresented", "plainly marked", "advertising materials",
)


@lru_cache(maxsize=1)
def rules() -> tuple[tuple[tuple[str, ...], str, str, int, float], ...]:
    """(gate words, regular expression, label, priority, confidence), in order."""
    out, gates = [], ()
    for line in RULES.splitlines():
        if line.startswith("="):
            gates = tuple(line[1:].split())
        elif line.strip():
            label, priority, confidence, pattern = line.split(" ", 3)
            out.append((gates, pattern.format(**FRAGMENTS), label, int(priority), float(confidence)))
    return tuple(out)


def _spaces(tree) -> int:
    """The most spaces that a match of a parsed pattern can hold, its look-ahead not counted."""
    total = 0
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            total += value == 32
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            _, high, inner = value
            each = _spaces(inner)
            if each:
                total += each * int(high)
        elif name == "SUBPATTERN":
            total += _spaces(value[-1])
        elif name == "BRANCH":
            total += max(_spaces(x) for x in value[1])
        elif name not in ("IN", "ASSERT", "ASSERT_NOT"):
            raise ValueError(f"{name} in a rule")
    return total


@lru_cache(maxsize=1)
def longest() -> int:
    """The number of words of the longest text that any rule can match."""
    return 1 + max(_spaces(parser.parse(pattern)) for _, pattern, *_ in rules())
