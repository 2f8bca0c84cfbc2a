"""Signatures of licenses over normalised words, written by hand.

A line holds a label, a priority (1 text of a license, 2 grant or notice, 3 name, address or tag,
4 weak sign), the words that a text must hold before the pattern is tried (spellings of one word
with a slash between them), and the pattern. Patterns
see lower-case words of letters and digits with one space between them. ``{lic}``, ``{v}`` and
``{the}`` stand for spellings of license, an optional word for version, and an optional article.
"""

from __future__ import annotations

_SPELLINGS = {"{lic}": "licen[cs]e", "{v}": "(?:version |ver |v ?)?", "{the}": "(?:the )?",
              "{gnu}": "(?:gnu )?", "{under}": "(?:under|subject to|governed by) (?:the (?:terms of the )?)?"}

LINES = r"""
mit | 1 | hereby obtaining | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 1 | noninfringement authors | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors
mit | 2 | mit | {under}mit {lic}
mit | 2 | mit | (?:mit licensed|licensed (?:as|with) mit)
mit | 2 | mit | (?:released|distributed|available|published|provided) {under}mit(?: {lic})?
mit | 3 | mit | {the}mit {lic}
mit | 3 | expat | (?:expat mit|mit expat|expat) {lic}
mit | 3 | mit spdx | spdx {lic} identifier mit
mit | 3 | opensource mit | opensource org licenses mit(?: license php)?
mit | 3 | mit license | license (?:type )?mit
mit-0 | 3 | mit attribution | mit no attribution(?: {lic})?
mit-0 | 3 | mit spdx | spdx {lic} identifier mit 0
x11 | 3 | x11/consortium | (?:x11|mit x11|x consortium) {lic}
x11 | 1 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
apache-2 | 1 | january apache | apache {lic} version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution
apache-2 | 1 | apache compliance | licensed under the apache {lic} version 2 0 the {lic} you may not use this file except in compliance with the {lic}
apache-2 | 2 | apache | {under}apache (?:software )?{lic} {v}2(?: 0)?
apache-2 | 2 | apache | (?:released|distributed|available|published|provided) {under}apache {v}2(?: 0)?(?: {lic})?
apache-2 | 3 | apache | apache (?:software )?{lic} {v}2(?: 0)?
apache-2 | 3 | apache | apache 2(?: 0)?(?: {lic})?
apache-2 | 3 | apache | apache org licenses license 2 0(?: txt| html)?
apache-2 | 3 | apache spdx | spdx {lic} identifier apache 2 0
apache-2 | 3 | asl | asl (?:{v}2 0|2)
apache-1.1 | 1 | apache foundation | this product includes software developed by the apache software foundation
apache-1.1 | 3 | apache | apache (?:software )?{lic} {v}1 1
apache-1.1 | 3 | apache spdx | spdx {lic} identifier apache 1 1
apache-1.0 | 3 | apache | apache (?:software )?{lic} {v}1 0
apache-unspecified | 4 | apache | {under}apache (?:software )?{lic}
gpl-1 | 2 | general public | {under}gnu general public {lic} {v}1(?: 0)?
gpl-1 | 3 | gpl | {gnu}gpl {v}1(?: 0)?
gpl-2 | 1 | june 1991 general | gnu general public {lic} version 2 june 1991 copyright c 1989 1991 free software foundation
gpl-2 | 1 | redistribute general | redistribute it and or modify it under the terms of the gnu general public {lic} as published by the free software foundation (?:either )?version 2 of the {lic}
gpl-2 | 2 | general public | {under}gnu general public {lic}(?: gpl)? {v}2(?: 0)?
gpl-2 | 2 | gpl/gplv2/gpl2 | {under}{gnu}(?:gpl {v}2|gplv2|gpl2)(?: 0)?
gpl-2 | 3 | general public | gnu general public {lic}(?: gpl)? {v}2(?: 0)?
gpl-2 | 3 | gpl | {gnu}gpl {v}2(?: 0)?(?: only| or later)?
gpl-2 | 3 | gplv2 | {gnu}gplv2(?: 0)?(?: only| or later)?
gpl-2 | 3 | gpl spdx | spdx {lic} identifier gpl 2 0(?: only| or later)?
gpl-2 | 3 | gnu licenses | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-2-classpath | 2 | classpath exception | gpl(?: version)? 2(?: 0)? with {the}classpath exception
gpl-2-classpath | 1 | link independent | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-3 | 1 | june 2007 general | gnu general public {lic} version 3 29 june 2007 copyright c 2007 free software foundation
gpl-3 | 1 | redistribute general | redistribute it and or modify it under the terms of the gnu general public {lic} as published by the free software foundation (?:either )?version 3 of the {lic}
gpl-3 | 2 | general public | {under}gnu general public {lic}(?: gpl)? {v}3(?: 0)?
gpl-3 | 2 | gpl/gplv3/gpl3 | {under}{gnu}(?:gpl {v}3|gplv3|gpl3)(?: 0)?
gpl-3 | 3 | general public | gnu general public {lic}(?: gpl)? {v}3(?: 0)?
gpl-3 | 3 | gpl | {gnu}gpl {v}3(?: 0)?(?: only| or later)?
gpl-3 | 3 | gplv3 | {gnu}gplv3(?: 0)?(?: only| or later)?
gpl-3 | 3 | gpl spdx | spdx {lic} identifier gpl 3 0(?: only| or later)?
gpl-3 | 3 | gnu licenses | gnu org licenses gpl(?: 3 0)?(?: en)?(?: html| txt)?
gpl-unspecified | 2 | general public | {under}gnu general public {lic}
gpl-unspecified | 4 | general public | gnu general public {lic}
gpl-unspecified | 4 | gpl | {gnu}gpl licensed
gpl-unspecified | 4 | gpl | (?:licensed|released|distributed|available) under {the}{gnu}gpl
lgpl-2 | 1 | june 1991 library | gnu library general public {lic} version 2 june 1991
lgpl-2 | 2 | library/lesser public | {under}gnu (?:library|lesser) general public {lic} {v}2(?: 0)?
lgpl-2 | 3 | lgpl | {gnu}lgpl {v}2(?: 0)?(?: only| or later)?
lgpl-2.1 | 1 | february 1999 lesser | gnu lesser general public {lic} version 2 1 february 1999
lgpl-2.1 | 1 | redistribute lesser | redistribute it and or modify it under the terms of the gnu lesser general public {lic} as published by the free software foundation (?:either )?version 2 1
lgpl-2.1 | 2 | lesser public | {under}gnu lesser general public {lic} {v}2 1
lgpl-2.1 | 3 | lesser public | gnu lesser general public {lic} {v}2 1
lgpl-2.1 | 3 | lgpl | {gnu}lgpl {v}2 1(?: only| or later)?
lgpl-2.1 | 3 | lgplv2 | {gnu}lgplv2 1(?: only| or later)?
lgpl-2.1 | 3 | lgpl spdx | spdx {lic} identifier lgpl 2 1(?: only| or later)?
lgpl-3 | 1 | june 2007 lesser | gnu lesser general public {lic} version 3 29 june 2007
lgpl-3 | 2 | lesser public | {under}gnu lesser general public {lic} {v}3(?: 0)?
lgpl-3 | 3 | lesser public | gnu lesser general public {lic} {v}3(?: 0)?
lgpl-3 | 3 | lgpl | {gnu}lgpl {v}3(?: 0)?(?: only| or later)?
lgpl-3 | 3 | lgplv3 | {gnu}lgplv3(?: 0)?(?: only| or later)?
lgpl-3 | 3 | gnu licenses | gnu org licenses lgpl 3 0(?: html| txt)?
lgpl-unspecified | 4 | lesser public | gnu lesser general public {lic}
lgpl-unspecified | 4 | library public | gnu library general public {lic}
lgpl-unspecified | 4 | lgpl | (?:licensed|released|distributed|available) under {the}{gnu}lgpl
agpl-1 | 3 | affero public | affero general public {lic} {v}1(?: 0)?
agpl-3 | 1 | november 2007 affero | gnu affero general public {lic} version 3 19 november 2007
agpl-3 | 1 | remotely interacting | offer all users interacting with it remotely through a computer network
agpl-3 | 2 | affero public | {under}gnu affero general public {lic} {v}3(?: 0)?
agpl-3 | 3 | affero public | gnu affero general public {lic} {v}3(?: 0)?
agpl-3 | 3 | agpl | {gnu}agpl {v}3(?: 0)?(?: only| or later)?
agpl-3 | 3 | agplv3 | {gnu}agplv3(?: 0)?(?: only| or later)?
agpl-3 | 3 | agpl spdx | spdx {lic} identifier agpl 3 0(?: only| or later)?
agpl-3 | 3 | gnu licenses | gnu org licenses agpl(?: 3 0)?(?: html| txt)?
agpl-unspecified | 4 | affero public | gnu affero general public {lic}
gfdl-1.1 | 3 | documentation free | gnu free documentation {lic} {v}1 1
gfdl-1.2 | 3 | documentation free | gnu free documentation {lic} {v}1 2
gfdl-1.3 | 1 | documentation granted | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {lic} version 1 3
gfdl-1.3 | 3 | documentation free | gnu free documentation {lic} {v}1 3
gfdl-unspecified | 4 | documentation free | gnu free documentation {lic}
gfdl-unspecified | 4 | gfdl/fdl | (?:gfdl|gnu fdl)
bsd-0 | 3 | bsd/0bsd | (?:bsd zero clause|zero clause bsd|0bsd)(?: {lic})?
bsd-0 | 1 | hereby fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
isc | 1 | hereby fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc | 2 | isc | {under}isc {lic}
isc | 3 | isc | {the}isc {lic}
isc | 3 | isc spdx | spdx {lic} identifier isc
bsd-1 | 3 | bsd | (?:bsd 1 clause|1 clause bsd)(?: {lic})?
bsd-2 | 1 | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided
bsd-2 | 2 | bsd/freebsd | {under}(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) {lic}
bsd-2 | 3 | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: {lic})?
bsd-2 | 3 | freebsd | freebsd {lic}
bsd-2 | 3 | bsd spdx | spdx {lic} identifier bsd 2 clause
bsd-2 | 3 | opensource bsd | opensource org licenses bsd 2 clause
bsd-3 | 1 | endorse | (?:neither the name of|the name of) (?:\S+ ){1,12}(?:may|nor the names of (?:its|their) contributors may) (?:not )?be used to endorse or promote products derived from this software
bsd-3 | 2 | bsd | {under}(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) {lic}
bsd-3 | 3 | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: {lic})?
bsd-3 | 3 | bsd spdx | spdx {lic} identifier bsd 3 clause
bsd-3 | 3 | opensource bsd | opensource org licenses bsd 3 clause
bsd-3-clear | 3 | bsd clear | (?:bsd 3 clause clear|clear bsd)(?: {lic})?
bsd-4 | 1 | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4 | 3 | bsd | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: {lic})?
bsd-unspecified | 2 | bsd | {under}bsd {lic}
bsd-unspecified | 4 | bsd | {the}bsd (?:style )?{lic}
mpl-1.0 | 3 | mozilla | mozilla public {lic} {v}1 0
mpl-1.1 | 1 | mozilla contents | the contents of this file are subject to the mozilla public {lic} version 1 1
mpl-1.1 | 3 | mozilla | mozilla public {lic} {v}1 1
mpl-1.1 | 3 | mpl | mpl {v}1 1
mpl-2 | 1 | mozilla form | this source code form is subject to the terms of the mozilla public {lic} v 2 0
mpl-2 | 2 | mozilla | {under}mozilla public {lic} {v}2(?: 0)?
mpl-2 | 3 | mozilla | mozilla public {lic} {v}2(?: 0)?
mpl-2 | 3 | mpl | mpl {v}2(?: 0)?
mpl-2 | 3 | mozilla mpl | mozilla org mpl 2 0
mpl-2 | 3 | mpl spdx | spdx {lic} identifier mpl 2 0
mpl-unspecified | 4 | mozilla | mozilla public {lic}
npl-1.1 | 3 | netscape | netscape public {lic}(?: {v}1 [01])?
epl-1 | 1 | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public {lic} v1 0
epl-1 | 3 | eclipse | eclipse public {lic} {v}1(?: 0)?
epl-1 | 3 | epl | epl {v}1 0
epl-2 | 1 | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public {lic} (?:v ?)?2 0
epl-2 | 3 | eclipse | eclipse public {lic} {v}2(?: 0)?
epl-2 | 3 | epl | epl {v}2 0
epl-2 | 3 | epl spdx | spdx {lic} identifier epl 2 0
edl-1 | 3 | eclipse | eclipse distribution {lic}(?: {v}1(?: 0)?)?
eupl-1.1 | 3 | european union | european union public {lic} {v}1 1
eupl-1.2 | 2 | european union | {under}european union public {lic} {v}1 2
eupl-1.2 | 3 | european union | european union public {lic}(?: {v}1 2)?
eupl-1.2 | 3 | eupl | eupl(?: {v}1 2)?
cddl-1.0 | 1 | development contents | the contents of this file are subject to the terms of the common development and distribution {lic}
cddl-1.0 | 3 | development distribution | common development and distribution {lic}(?: cddl)?(?: {v}1 0)?
cddl-1.0 | 3 | cddl | cddl(?: {v}1 0)?
cddl-1.1 | 3 | cddl | cddl {v}1 1
cpl-1 | 3 | common public | common public {lic}(?: {v}1(?: 0)?)?
cpal-1 | 3 | common attribution | common public attribution {lic}(?: {v}1(?: 0)?)?
ipl-1 | 3 | ibm public | ibm public {lic}(?: {v}1(?: 0)?)?
osl-1 | 3 | open software | open software {lic} {v}1(?: [01])?
osl-2 | 3 | open software | open software {lic} {v}2(?: [01])?
osl-3 | 2 | open software | {under}open software {lic} {v}3(?: 0)?
osl-3 | 3 | open software | open software {lic} {v}3(?: 0)?
afl-2 | 3 | academic free | academic free {lic} {v}2(?: [01])?
afl-3 | 3 | academic free | academic free {lic} {v}3(?: 0)?
ms-pl | 2 | microsoft public | {under}microsoft public {lic}
ms-pl | 3 | microsoft public | microsoft public {lic}(?: ms pl)?
ms-pl | 3 | ms pl | ms pl
ms-rl | 3 | microsoft reciprocal | microsoft reciprocal {lic}(?: ms rl)?
artistic-1 | 3 | artistic | artistic {lic} {v}1(?: 0)?
artistic-2 | 1 | establishes modified | this {lic} establishes the terms under which a given free software package may be copied modified distributed and or redistributed
artistic-2 | 3 | artistic | artistic {lic} {v}2(?: 0)?
artistic-unspecified | 4 | artistic | {the}artistic {lic}
perl | 2 | perl itself | under the same terms as perl(?: [0-9 ]+)? itself
ruby | 3 | ruby | (?:ruby {lic}|ruby s {lic}|same terms as ruby)
php-3 | 1 | php freely | this product includes php software freely available
php-3 | 3 | php | php {lic}(?: {v}3(?: 0[01]?| 01)?)?
python-2 | 3 | psf/python | (?:python software foundation|psf) {lic}(?: {v}2)?
python-2 | 1 | psf licensee | psf hereby grants licensee a nonexclusive royalty free world wide {lic}
cnri-python | 3 | cnri | cnri python {lic}
zope-2 | 3 | zope | zope public {lic}(?: zpl)?(?: {v}2(?: [01])?)?
zlib | 1 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 2 | zlib | {under}zlib(?: libpng)? {lic}
zlib | 3 | zlib | {the}zlib(?: libpng)? {lic}
libpng | 3 | libpng | libpng {lic}(?: {v}2)?
bsl-1 | 1 | organization hereby | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this {lic}
bsl-1 | 2 | boost | {under}boost software {lic}(?: {v}1(?: 0)?)?
bsl-1 | 3 | boost | boost software {lic}(?: {v}1(?: 0)?)?
bsl-1 | 3 | boost | boost org license 1 0(?: txt)?
bsl-1 | 3 | bsl spdx | spdx {lic} identifier bsl 1 0
busl-1.1 | 3 | business source | business source {lic}(?: {v}1 1)?
busl-1.1 | 1 | additional production | licensor may make an additional use grant above permitting limited production use
sspl-1 | 2 | server side | {under}server side public {lic}(?: {v}1)?
sspl-1 | 3 | server side | server side public {lic}(?: {v}1)?
sspl-1 | 3 | sspl | sspl(?: {v}1(?: 0)?)?
elastic-2 | 2 | elastic | {under}elastic {lic} {v}2(?: 0)?
elastic-2 | 3 | elastic | elastic {lic}(?: {v}2(?: 0)?)?
commons-clause | 1 | commons condition | commons clause {lic} condition v1 0
commons-clause | 3 | clause commons | {the}commons clause
polyform | 3 | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|internal use)(?: {lic})?
confluent | 3 | confluent | confluent community {lic}(?: agreement)?
redis-sal | 3 | redis | redis source available {lic}(?: agreement)?
timescale | 3 | timescale | timescale {lic}(?: agreement)?
unlicense | 1 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 3 | unlicense | (?:the unlicense|unlicense org|spdx {lic} identifier unlicense)
wtfpl | 1 | fuck public | do what the fuck you want to public {lic}
wtfpl | 3 | wtfpl | wtfpl(?: {v}2)?
beerware | 3 | beer/beerware | (?:the )?beer ?ware {lic}
beerware | 1 | beer worth | if we meet some day and you think this stuff is worth it you can buy me a beer
json | 1 | evil | the software shall be used for good not evil
jsr-305 | 4 | java specification | java community process specification {lic}
openssl | 1 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 3 | openssl | openssl {lic}
curl | 3 | curl | curl {lic}
icu | 3 | icu | icu {lic}
unicode | 3 | unicode | unicode (?:inc )?{lic}(?: agreement)?(?: {v}3)?
w3c | 1 | holders following | this work is being provided by the copyright holders under the following {lic}
w3c | 3 | w3c | w3c software(?: notice and| and document)?(?: notice and)? {lic}
ofl-1.1 | 1 | font sil | this font software is licensed under the sil open font {lic} version 1 1
ofl-1.1 | 2 | sil font | {under}sil open font {lic}(?: {v}1 1)?
ofl-1.1 | 3 | sil font | sil open font {lic}(?: {v}1 1)?
ofl-1.1 | 3 | ofl | (?:sil )?ofl {v}1 1
ufl-1 | 3 | ubuntu font | ubuntu font {lic}(?: {v}1 0)?
ncsa | 3 | illinois | university of illinois(?: at urbana champaign)?(?: ncsa)? open source {lic}
ncsa | 3 | ncsa | ncsa(?: open source)? {lic}
llvm-exception | 3 | llvm exception/exceptions | apache(?: {lic})? {v}2 0 with llvm exceptions?
tcl | 3 | tcl | tcl tk {lic}
vim | 3 | vim | {the}vim {lic}
sleepycat | 3 | sleepycat | sleepycat {lic}
postgresql | 1 | california consequential | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
postgresql | 2 | postgresql | {under}postgresql {lic}
postgresql | 3 | postgresql | {the}postgresql {lic}
upl-1 | 3 | universal permissive | universal permissive {lic}(?: {v}1(?: 0)?)?
qpl-1 | 3 | q public | q public {lic}(?: {v}1(?: 0)?)?
cecill | 2 | cecill | (?:régi par la licence |{under})cecill(?: [bc])?(?: {lic})?
cecill | 3 | cecill | cecill(?: [bc])?(?: {v}[12](?: [01])?)?(?: {lic})?
mulan-2 | 3 | mulan | mulan (?:psl|permissive software {lic}) ?{v}2
hippocratic | 3 | hippocratic | hippocratic {lic}(?: {v}[123](?: [01])?)?
anti-996 | 3 | 996 | anti 996 {lic}
blueoak-1 | 3 | blue oak | blue oak model {lic}(?: {v}1(?: 0 0)?)?
ecl-2 | 3 | educational community | educational community {lic}(?: {v}2(?: 0)?)?
nasa-1.3 | 3 | nasa | nasa open source agreement(?: {v}1 3)?
intel | 3 | intel | intel open source {lic}
apsl-2 | 3 | apple | apple public source {lic}(?: {v}[12](?: [012])?)?
sissl | 3 | sun industry | sun industry standards source {lic}
spl | 3 | sun public | sun public {lic}
bitstream | 3 | bitstream | bitstream vera(?: fonts?)? (?:copyright|{lic})
fsful | 1 | unlimited configure | this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it
gust-font | 3 | gust font | gust font {lic}
lppl-1.3c | 1 | latex project | this work may be distributed and or modified under the conditions of the latex project public {lic}
lppl-1.3c | 3 | latex project | latex project public {lic}(?: {v}1 [0123]c?)?
cc0-1 | 1 | affirmer waives | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright
cc0-1 | 2 | cc0 | (?:released|dedicated|available|licensed) {under}(?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0-1 | 3 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1 | 3 | creativecommons zero | creativecommons org publicdomain zero 1 0
cc-by-nc-nd | 2 | cc nc nd | {under}(?:a )?(?:creative commons )?cc by nc nd(?: [1-4] [05])?
cc-by-nc-nd | 3 | cc nc nd | cc by nc nd(?: [1-4] [05])?
cc-by-nc-nd | 3 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: {lic})?
cc-by-nc-nd | 3 | creativecommons nc nd | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 2 | cc nc sa | {under}(?:a )?(?:creative commons )?cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa | 3 | cc nc sa | cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa | 3 | creative commons attribution | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: {lic})?
cc-by-nc-sa | 3 | creativecommons nc sa | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc | 2 | cc nc | {under}(?:a )?(?:creative commons )?cc by nc(?: [1-4] [05])?(?: {lic})?
cc-by-nc | 3 | cc nc | cc by nc(?: [1-4] [05])?
cc-by-nc | 3 | creative commons attribution | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: {lic})?
cc-by-nc | 3 | creativecommons nc | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd | 2 | cc nd | {under}(?:a )?(?:creative commons )?cc by nd(?: [1-4] [05])?
cc-by-nd | 3 | cc nd | cc by nd(?: [1-4] [05])?
cc-by-nd | 3 | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: {lic})?
cc-by-nd | 3 | creativecommons nd | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-sa | 2 | cc sa | {under}(?:a )?(?:creative commons )?cc by sa(?: [1-4] [05])?
cc-by-sa | 3 | cc sa | cc by sa(?: [1-4] [05])?
cc-by-sa | 3 | creative commons attribution | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: {lic})?
cc-by-sa | 3 | creativecommons sa | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by | 2 | cc by | {under}(?:a )?(?:creative commons )?cc by(?: [1-4] [05])?(?: {lic})?
cc-by | 3 | cc by | cc by [1-4] [05]
cc-by | 3 | creative commons attribution | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? {lic}
cc-by | 3 | creativecommons by | creativecommons org licenses by(?: [1-4] [05])?
cc-unspecified | 4 | creative commons | {under}(?:a )?creative commons {lic}
odbl-1 | 2 | database open | {under}open (?:data commons open )?database {lic}(?: {v}1(?: 0)?)?
odbl-1 | 3 | odbl | (?:odc )?odbl(?: {v}1(?: 0)?)?
odbl-1 | 3 | database open | open database {lic}(?: odbl)?(?: {v}1(?: 0)?)?
odc-by-1 | 3 | commons data | open data commons attribution {lic}(?: {v}1(?: 0)?)?
odc-by-1 | 3 | odc | odc by(?: {v}1(?: 0)?)?
pddl-1 | 3 | pddl/dedication | (?:pddl|odc pddl|open data commons public domain dedication and {lic})(?: {v}1(?: 0)?)?
cdla-permissive | 3 | community data | community data {lic} agreement permissive(?: {v}[12](?: 0)?)?
cdla-sharing | 3 | community data | community data {lic} agreement sharing(?: {v}1(?: 0)?)?
ogl-3 | 2 | open government | {under}open government {lic}(?: {v}[123](?: 0)?)?
ogl-3 | 3 | open government | open government {lic}(?: {v}[123](?: 0)?)?
etalab-2 | 3 | ouverte | licence ouverte(?: open licence)?(?: etalab)?(?: {v}[12](?: 0)?)?
dl-de-by-2 | 3 | datenlizenz | datenlizenz deutschland namensnennung(?: {v}2(?: 0)?)?
openrail | 3 | openrail/rail | (?:creativeml |bigscience |bigcode )?open ?rail(?: [ms]| plus plus m)?(?: {lic})?
openrail | 3 | rail | bigscience (?:bloom )?rail(?: {lic})?(?: {v}1 0)?
llama | 3 | llama | llama (?:[23](?: [1-3])? )?community {lic}(?: agreement)?
gemma | 3 | gemma | gemma terms of use
public-domain | 2 | domain | (?:released|dedicated|placed|put) (?:in|into|to) the public domain
public-domain | 3 | domain | (?:is|are|was) in the public domain
public-domain | 4 | domain | public domain
proprietary | 1 | confidential/proprietary information | this (?:software|document|file|work) (?:is|contains) (?:the )?(?:confidential|proprietary)(?: and (?:confidential|proprietary))? information
proprietary | 2 | reserved | copyright(?: c)?(?: [0-9]{4}){1,2}(?: \S+){1,8} all rights reserved
proprietary | 2 | strictly prohibited | (?:unauthori[sz]ed )?(?:copying|reproduction|redistribution)(?: or distribution)?(?: of this \S+)?(?: via any medium)? is strictly prohibited
proprietary | 3 | reserved | all rights (?:are )?reserved
proprietary | 3 | droits réservés | tous droits réservés
proprietary | 3 | rechte vorbehalten | alle rechte vorbehalten
proprietary | 3 | derechos reservados | todos los derechos reservados
proprietary | 4 | eula/agreement | (?:eula|end user {lic} agreement)
shareware | 4 | shareware | this (?:program|software) is shareware
freeware | 4 | freeware | this (?:program|software) is freeware
non-commercial | 2 | only use/purposes | for (?:non ?commercial|personal|academic|research|educational)(?: and (?:non ?commercial|personal|academic|research|educational))? (?:use|purposes) only
non-commercial | 4 | commercial | (?:not for|no) commercial use
copyleft-unspecified | 4 | copyleft | copyleft {lic}
open-source-unspecified | 4 | source | (?:released|available|distributed) under an? (?:\S+ )?open source {lic}
"""


def rules() -> list[tuple[str, int, tuple[frozenset[bytes], ...], bytes]]:
    """Label, priority, needed words and pattern of each signature, in the order written.

    Needed words are groups of spellings; a text must hold one of each group.
    """
    out = []
    for line in LINES.strip().splitlines():
        label, priority, needs, pattern = (part.strip() for part in line.split(" | "))
        for mark, spelling in _SPELLINGS.items():
            pattern = pattern.replace(mark, spelling)
        groups = tuple(frozenset(group.encode().split(b"/")) for group in needs.split())
        out.append((label, int(priority), groups, pattern.encode()))
    return out
