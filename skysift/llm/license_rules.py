"""Hand-written signatures of licenses, one a line: priority, label, keyword, pattern.

Texts are matched as lower-case words with single blanks between them, so ``Apache-2.0`` reads ``apache 2 0``.  The keyword gates
its rule; the pattern matches whole words.  Priorities: 100 tags, 95 notices and grants that name a version, 85 grants,
75 sentences of the license text, 70 addresses, 60 names with a version, 50 names, 40 short names with a version, 30 mentions.
"""

SIGNATURES = r"""
100 gpl-1.0 | spdx | spdx license identifier gpl 1 0(?: only| or later)?
100 gpl-2.0 | spdx | spdx license identifier gpl 2 0(?: only| or later)?
100 gpl-2.0-classpath | spdx | spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0
100 gpl-2.0-linux | spdx | spdx license identifier gpl 2 0(?: only| or later)? with linux syscall note
100 gpl-3.0 | spdx | spdx license identifier gpl 3 0(?: only| or later)?
100 gpl-3.0-gcc | spdx | spdx license identifier gpl 3 0(?: only| or later)? with gcc exception 3 1
100 lgpl-2.0 | spdx | spdx license identifier lgpl 2 0(?: only| or later)?
100 lgpl-2.1 | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
100 lgpl-3.0 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
100 agpl-3.0 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
100 gfdl | spdx | spdx license identifier gfdl 1 [123](?: only| or later)?
100 apache-1.1 | spdx | spdx license identifier apache 1 1
100 apache-2.0 | spdx | spdx license identifier apache 2 0
100 apache-2.0-llvm | spdx | spdx license identifier apache 2 0 with llvm exception
100 mit | spdx | spdx license identifier mit
100 mit-0 | spdx | spdx license identifier mit 0
100 bsd-0 | spdx | spdx license identifier 0bsd
100 bsd-1-clause | spdx | spdx license identifier bsd 1 clause
100 bsd-2-clause | spdx | spdx license identifier bsd 2 clause(?: patent)?
100 bsd-3-clause | spdx | spdx license identifier bsd 3 clause(?: clear| lbnl)?
100 bsd-4-clause | spdx | spdx license identifier bsd 4 clause(?: uc)?
100 isc | spdx | spdx license identifier isc
100 zlib | spdx | spdx license identifier zlib
100 mpl-1.1 | spdx | spdx license identifier mpl 1 1
100 mpl-2.0 | spdx | spdx license identifier mpl 2 0
100 epl-1.0 | spdx | spdx license identifier epl 1 0
100 epl-2.0 | spdx | spdx license identifier epl 2 0
100 cddl-1.0 | spdx | spdx license identifier cddl 1 [01]
100 eupl | spdx | spdx license identifier eupl 1 [12]
100 osl-3.0 | spdx | spdx license identifier osl 3 0
100 afl | spdx | spdx license identifier afl [23] [01]
100 artistic-2.0 | spdx | spdx license identifier artistic [12] 0
100 bsl-1.0 | spdx | spdx license identifier bsl 1 0
100 busl-1.1 | spdx | spdx license identifier busl 1 1
100 python-2.0 | spdx | spdx license identifier (?:python|psf) 2 0
100 postgresql | spdx | spdx license identifier postgresql
100 ofl-1.1 | spdx | spdx license identifier ofl 1 [01]
100 unlicense | spdx | spdx license identifier unlicense
100 wtfpl | spdx | spdx license identifier wtfpl
100 cc0-1.0 | spdx | spdx license identifier cc0 1 0
100 cc-by | spdx | spdx license identifier cc by [1234] [05]
100 cc-by-sa | spdx | spdx license identifier cc by sa [1234] [05]
100 cc-by-nc | spdx | spdx license identifier cc by nc [1234] [05]
100 cc-by-nd | spdx | spdx license identifier cc by nd [1234] [05]
100 cc-by-nc-sa | spdx | spdx license identifier cc by nc sa [1234] [05]
100 cc-by-nc-nd | spdx | spdx license identifier cc by nc nd [1234] [05]
100 odbl-1.0 | spdx | spdx license identifier odbl 1 0
100 ms-pl | spdx | spdx license identifier ms pl
100 ncsa | spdx | spdx license identifier ncsa
100 ecl-2.0 | spdx | spdx license identifier ecl 2 0
95 apache-2.0 | apache license | licensed under the apache license version 2 0(?: the license)?
95 apache-2.0 | apache license | (?:released|distributed|available|published|provided) under the (?:terms of the )?apache license (?:version |v )?2(?: 0)?
95 apache-2.0 | apache 2 | licensed under (?:the )?apache 2(?: 0)?(?: license)?
95 apache-2.0 | apache license | licensed under (?:the )?apache license 2(?: 0)?
95 apache-2.0 | apache 2 | (?:released|distributed|available|published) under (?:the )?apache 2(?: 0)?(?: license)?
95 gpl-2.0 | gnu general public license | terms of (?:the )?(?:version 2 of the gnu general public license|gnu general public license (?:as published by the free software foundation )?(?:either )?version 2)(?: of the license)?(?: or at your option any later version)?
95 gpl-3.0 | gnu general public license | terms of (?:the )?(?:version 3 of the gnu general public license|gnu general public license (?:as published by the free software foundation )?(?:either )?version 3)(?: of the license)?(?: or at your option any later version)?
95 gpl-2.0 | general public license | licensed under (?:the )?(?:terms of )?(?:the )?gnu general public license (?:version |v )?2(?: 0)?(?: or later| only)?
95 gpl-3.0 | general public license | licensed under (?:the )?(?:terms of )?(?:the )?gnu general public license (?:version |v )?3(?: 0)?(?: or later| only)?
95 gpl-2.0 | gpl | licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl ?(?:version |v)? ?2(?: 0)?(?: or later| only)?
95 gpl-3.0 | gpl | licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl ?(?:version |v)? ?3(?: 0)?(?: or later| only)?
95 gpl-2.0 | gplv2 | licensed under (?:the )?(?:gnu )?gplv2(?: or later| only)?
95 gpl-3.0 | gplv3 | licensed under (?:the )?(?:gnu )?gplv3(?: or later| only)?
95 lgpl-2.1 | lesser general public license | terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license
95 lgpl-3.0 | lesser general public license | terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license
95 lgpl-2.0 | library general public license | terms of the gnu library general public license as published by the free software foundation either version 2 of the license
95 lgpl-2.1 | lgpl | licensed under (?:the )?(?:gnu )?lgpl ?(?:version |v)? ?2 1(?: or later| only)?
95 lgpl-3.0 | lgpl | licensed under (?:the )?(?:gnu )?lgpl ?(?:version |v)? ?3(?: 0)?(?: or later| only)?
95 agpl-3.0 | affero general public license | terms of the gnu affero general public license as published by the free software foundation either version 3 of the license
95 agpl-3.0 | agpl | licensed under (?:the )?(?:gnu )?agpl ?(?:version |v)? ?3(?: 0)?(?: or later| only)?
95 mpl-2.0 | mozilla public license | subject to the terms of the mozilla public license v 2 0
95 mpl-1.1 | mozilla public license | subject to the mozilla public license version 1 1
95 mpl-2.0 | mpl | licensed under (?:the )?mpl 2(?: 0)?
95 mpl-2.0 | mozilla public license | licensed under (?:the )?mozilla public license (?:version |v )?2 0
95 epl-1.0 | eclipse public license | terms of the eclipse public license v ?1 0
95 epl-2.0 | eclipse public license | terms of the eclipse public license (?:v |v|version )?2 0
95 epl-2.0 | epl 2 | licensed under (?:the )?epl 2 0
95 cddl-1.0 | common development and distribution | subject to the terms of the common development and distribution license(?: the license)?
95 bsl-1.0 | boost software license | distributed under the boost software license version 1 0
95 ofl-1.1 | sil open font license | licensed under the sil open font license version 1 1
95 cc-by-4.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution 4 0 international(?: license| licence)?
95 cc-by-sa-4.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution share ?alike 4 0 international(?: license| licence)?
95 cc-by-nc-4.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution non ?commercial 4 0 international(?: license| licence)?
95 cc-by-nd-4.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution no ?deriv(?:ative)?s 4 0 international(?: license| licence)?
95 cc-by-nc-sa-4.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike 4 0 international(?: license| licence)?
95 cc-by-nc-nd-4.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0 international(?: license| licence)?
95 cc-by-sa-3.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution share ?alike 3 0 (?:unported|united states)(?: license| licence)?
95 cc-by-3.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution 3 0 (?:unported|united states)(?: license| licence)?
95 cc-by | cc by | licensed under (?:a |the )?cc by [1234] [05]
95 cc-by-sa | cc by sa | licensed under (?:a |the )?cc by sa [1234] [05]
95 cc-by-nc | cc by nc | licensed under (?:a |the )?cc by nc [1234] [05]
95 cc-by-nd | cc by nd | licensed under (?:a |the )?cc by nd [1234] [05]
95 cc-by-nc-sa | cc by nc sa | licensed under (?:a |the )?cc by nc sa [1234] [05]
95 cc-by-nc-nd | cc by nc nd | licensed under (?:a |the )?cc by nc nd [1234] [05]
85 mit | mit license | (?:dual |re)?licensed under (?:the )?(?:terms of )?(?:the )?mit license
85 mit | mit | licensed under (?:the )?mit
85 mit | mit license | (?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit license
85 mit | mit | (?:released|distributed|available|published) under mit
85 mit | mit license | this (?:project|software|work|code|library|package|repository) is (?:covered by|subject to) the mit license
85 mit | expat | licensed under (?:the )?(?:mit expat|expat mit|expat) license
85 apache | apache | (?:dual |re)?licensed under (?:the )?(?:terms of )?(?:the )?apache (?:software )?license
85 apache | apache | (?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?license
85 apache | apache | licensed under apache
85 bsd | bsd | (?:dual |re)?licensed under (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)? license
85 bsd | bsd | (?:released|distributed|available|published|provided) under (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)?(?: license)?
85 bsd-2-clause | bsd | licensed under (?:the |a )?(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?
85 bsd-3-clause | bsd | licensed under (?:the |a )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?
85 bsd-4-clause | bsd | licensed under (?:the |a )?(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?
85 gpl | general public license | (?:dual |re)?licensed under (?:the )?(?:terms of )?(?:the )?gnu general public license
85 gpl | gpl | (?:dual |re)?licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
85 gpl | general public license | (?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?gnu general public license
85 gpl | gpl | (?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
85 lgpl | lesser general public license | licensed under (?:the )?(?:terms of )?(?:the )?gnu lesser general public license
85 lgpl | lgpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
85 agpl | affero general public license | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?gnu affero general public license
85 agpl | agpl | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?agpl
85 gfdl | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
85 mpl | mozilla public license | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mozilla public license
85 mpl | mpl | (?:licensed|released|distributed|available) under (?:the )?mpl
85 epl | eclipse public license | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?eclipse public license
85 isc | isc license | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?isc license
85 isc | isc | licensed under (?:the )?isc
85 zlib | zlib | (?:licensed|released|distributed|available) under (?:the )?zlib(?: libpng)?(?: license)?
85 unlicense | unlicense | (?:licensed|released|distributed|available) under (?:the )?unlicense
85 wtfpl | wtfpl | (?:licensed|released|distributed|available) under (?:the )?wtfpl
85 cc-by | cc by | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by
85 cc-by-sa | cc by sa | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by sa
85 cc-by-nc | cc by nc | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by nc
85 cc-by-nd | cc by nd | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by nd
85 cc-by-nc-sa | cc by nc sa | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by nc sa
85 cc-by-nc-nd | cc by nc nd | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by nc nd
85 cc | creative commons | (?:licensed|released|distributed|available|published) under (?:a |the )?creative commons(?: license| licence)?
85 cc0 | cc0 | (?:licensed|released|dedicated|available|published) (?:under|to|with) (?:a |the )?cc0
85 artistic | artistic license | (?:licensed|released|distributed|available) under (?:the )?(?:perl )?artistic license
85 perl | perl itself | under the same terms as perl itself
85 ruby | ruby | under the same terms as ruby(?: itself)?
85 python | python software foundation | (?:licensed|released|distributed|available) under (?:the )?python software foundation license
85 python | psf license | (?:licensed|released|distributed|available) under (?:the )?psf license
85 eupl | eupl | licensed under the eupl
85 boost | boost software license | (?:licensed|released|available) under (?:the )?boost software license
85 ofl | open font license | (?:licensed|released|distributed|available) under (?:the )?(?:sil )?open font license
85 odbl | open database license | (?:licensed|made available|available) under the open database license
85 proprietary | proprietary license | (?:licensed|distributed|available) under (?:a |the )?proprietary license
85 proprietary | commercial license | (?:licensed|distributed|available) under (?:a |the )?commercial license
75 mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
75 mit | above copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
75 mit | without warranty of any kind | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
75 isc | permission to use copy modify | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
75 isc | author disclaims | the software is provided as is and the author disclaims all warranties with regard to this software
75 bsd-0 | permission to use copy modify | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided as is
75 ntp | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee |with or without fee )?is hereby granted
75 bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
75 bsd | redistribution | redistributions of source code must retain the above copyright notice(?: this list of conditions and the following disclaimer)?
75 bsd | redistribution | redistributions in binary form must reproduce the above copyright notice(?: this list of conditions and the following disclaimer)?
75 bsd-3-clause | endorse or promote | neither the names? of (?:\S+ ){1,20}?(?:nor the names of (?:its|their|the) contributors )?may be used to endorse or promote products
75 bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
75 bsd | express or implied warranties | this software is provided by the (?:copyright holders and contributors|regents and contributors|author)(?: as is)? and any express or implied warranties
75 apache-2.0 | except in compliance | you may not use this file except in compliance with the license
75 apache-2.0 | as is basis | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
75 apache-2.0 | copyright license | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
75 apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
75 apache | contributor license agreements | licensed to the apache software foundation asf under one or more contributor license agreements
75 gpl | free software | this (?:program|file|library|software|package) is free software you can redistribute it and or modify it under the terms of the gnu general public license
75 gpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
75 gpl | copy of the gnu general public license | you should have received a copy of the gnu general public license along with this (?:program|file|library|software|package)
75 lgpl | copy of the gnu lesser | you should have received a copy of the gnu lesser general public license along with this (?:program|file|library|software|package)
75 lgpl | lesser general public license | this (?:program|file|library|software|package) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
75 lgpl-2.0 | library general public license | this (?:program|file|library|software|package) is free software you can redistribute it and or modify it under the terms of the gnu library general public license
75 agpl | copy of the gnu affero | you should have received a copy of the gnu affero general public license along with this (?:program|file|library|software|package)
75 agpl | affero general public license | redistribute it and or modify it under the terms of the gnu affero general public license
75 agpl | interacting with it remotely | users interacting with it remotely through a computer network
75 gpl-3.0 | other practical works | the licenses for most software and other practical works are designed to take away your freedom to share and change the works
75 gpl-2.0 | take away your freedom | the licenses for most software are designed to take away your freedom to share and change it
75 gfdl | no invariant sections | with no invariant sections no front cover texts and no back cover texts
75 gpl-classpath | special exception | as a special exception the copyright holders of this library give you permission to link this library
75 gpl-gcc | runtime library exception | under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception
75 mpl-2.0 | mozilla public license | this source code form is subject to the terms of the mozilla public license
75 mpl-2.0 | mozilla org mpl | if a copy of the mpl was not distributed with this file you can obtain one at (?:http|https) mozilla org mpl 2 0
75 mpl-1.1 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license
75 epl | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license
75 cddl | common development and distribution | the contents of this file are subject to the terms of the common development and distribution license
75 bsl-1.0 | boost org | see accompanying file license 1 0 txt or copy at (?:http|https) www boost org license 1 0 txt
75 zlib | express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
75 zlib | plainly marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
75 libpng | libpng | this code is released under the libpng license
75 unlicense | unencumbered | this is free and unencumbered software released into the public domain
75 unlicense | sell or distribute | anyone is free to copy modify publish use compile sell or distribute this software
75 wtfpl | what the fuck | you just do what the fuck you want to
75 wtfpl | what the fuck | do what the fuck you want to public license
75 cc0 | dedicated the work | the person who associated a work with this deed has dedicated the work to the public domain
75 cc0 | waived all copyright | to the extent possible under law (?:\S+ ){0,8}?has waived all copyright and related or neighboring rights
75 public-domain | public domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
75 public-domain | public domain | (?:is|are|was) (?:hereby )?(?:in|part of) the public domain
75 public-domain | disclaims copyright | the author disclaims copyright to this source code
75 public-domain | no copyright | no copyright is claimed(?: in the united states)?
75 beerware | beer ware | the beer ware license
75 beerware | buy me a beer | you can buy me a beer in return
75 json | good not evil | the software shall be used for good not evil
75 openssl | openssl project | this product includes software developed by the openssl project for use in the openssl toolkit
75 openssl | cryptographic software | this product includes cryptographic software written by eric young
75 php | php software | this product includes php software freely available from
75 zend | zend engine | this product includes the zend engine freely available at
75 curl | except as contained in this notice | except as contained in this notice the name of a copyright holder shall not be used in advertising
75 x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
75 ncsa | ncsa | university of illinois ncsa open source license
75 postgresql | postgresql | postgresql is released under the postgresql license
75 postgresql | university of california be liable | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
75 hpnd | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies
75 artistic-2.0 | artistic license | this is free software you may redistribute it and or modify it under the terms of the artistic license 2 0
75 artistic | standard version | you may make and give away verbatim copies of the source form of the standard version of this package
75 ofl | reserved font name | no modified version of the font software may use the reserved font name
75 ofl | font software | the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself
75 busl | non production use | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
75 sspl | third parties as a service | functionality of the program or modified version available to third parties as a service
75 elastic | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
75 commons-clause | right to sell the software | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
75 ms-pl | you accept this license | if you use the software you accept this license if you do not accept the license do not use the software
75 qpl | q public license | this software is released under the q public license
75 ipl | ibm public license | the accompanying program is provided under the terms of this ibm public license
75 cpl | common public license | the accompanying program is provided under the terms of this common public license
75 nasa | this open source agreement | this open source agreement defines the rights of use reproduction distribution modification and redistribution of certain computer software originally released by the united states government
75 upl | universal permissive | the universal permissive license upl version 1 0
75 odbl | database contents | any rights in individual contents of the database are licensed under the database contents license
75 cc-by-sa | same license as the original | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
75 cc-by-nc | commercial purposes | you may not use the material for commercial purposes
75 cc-by-nd | distribute the modified material | if you remix transform or build upon the material you may not distribute the modified material
75 proprietary | confidential and proprietary | (?:this (?:software|document|file) is )?(?:the )?confidential and proprietary (?:information|property) of
75 proprietary | this file via any medium | unauthori[sz]ed copying of this file via any medium is strictly prohibited
75 proprietary | reverse engineer | you may not (?:copy modify |decompile )?reverse engineer
75 proprietary | prior written | may not be (?:reproduced|copied|distributed)(?: in whole or in part)?(?: in any form)? without (?:the )?prior written (?:permission|consent)
75 proprietary | end user license agreement | (?:this )?end user license agreement(?: eula)? is a legal agreement
70 apache-2.0 | apache org licenses | (?:http|https) (?:www )?apache org licenses license 2 0(?: txt| html)?
70 gpl | gnu org | (?:http|https) (?:www )?gnu org (?:licenses|copyleft)(?: gpl)?(?: html| txt)?
70 gpl-2.0 | gnu org licenses | (?:http|https) (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| en html| txt)?
70 gpl-3.0 | gnu org licenses | (?:http|https) (?:www )?gnu org licenses gpl 3 0(?: html| en html| txt)?
70 lgpl | gnu org licenses | (?:http|https) (?:www )?gnu org licenses (?:old licenses )?lgpl(?: [23] [01])?(?: html| en html| txt)?
70 agpl | gnu org licenses | (?:http|https) (?:www )?gnu org licenses agpl(?: 3 0)?(?: html| en html| txt)?
70 gfdl | gnu org licenses | (?:http|https) (?:www )?gnu org licenses fdl(?: 1 [123])?(?: html| en html| txt)?
70 mit | opensource org licenses | (?:http|https) (?:www )?opensource org licenses? mit(?: license)?(?: php| html)?
70 bsd-2-clause | opensource org licenses | (?:http|https) (?:www )?opensource org licenses? bsd 2 clause
70 bsd-3-clause | opensource org licenses | (?:http|https) (?:www )?opensource org licenses? bsd 3 clause
70 bsd | opensource org licenses | (?:http|https) (?:www )?opensource org licenses? bsd license(?: php)?
70 isc | opensource org licenses | (?:http|https) (?:www )?opensource org licenses? isc
70 zlib | opensource org licenses | (?:http|https) (?:www )?opensource org licenses? zlib(?: license)?(?: php)?
70 apache-2.0 | opensource org licenses | (?:http|https) (?:www )?opensource org licenses? apache 2 0
70 mpl-2.0 | mozilla org | (?:http|https) (?:www )?mozilla org (?:en us )?mpl 2 0
70 mpl-1.1 | mozilla org | (?:http|https) (?:www )?mozilla org mpl (?:mpl )?1 1(?: html)?
70 epl-1.0 | eclipse org legal | (?:http|https) (?:www )?eclipse org legal epl v10(?: html)?
70 epl-2.0 | eclipse org legal | (?:http|https) (?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?
70 bsl-1.0 | boost org | (?:http|https) (?:www )?boost org license 1 0(?: txt)?
70 unlicense | unlicense org | (?:http|https) unlicense org
70 wtfpl | wtfpl net | (?:http|https) (?:www )?wtfpl net
70 cc0-1.0 | creativecommons org | (?:http|https) (?:www )?creativecommons org publicdomain zero 1 0
70 cc-by | creativecommons org | (?:http|https) (?:www )?creativecommons org licenses by [1234] [05]
70 cc-by-sa | creativecommons org | (?:http|https) (?:www )?creativecommons org licenses by sa [1234] [05]
70 cc-by-nc | creativecommons org | (?:http|https) (?:www )?creativecommons org licenses by nc [1234] [05]
70 cc-by-nd | creativecommons org | (?:http|https) (?:www )?creativecommons org licenses by nd [1234] [05]
70 cc-by-nc-sa | creativecommons org | (?:http|https) (?:www )?creativecommons org licenses by nc sa [1234] [05]
70 cc-by-nc-nd | creativecommons org | (?:http|https) (?:www )?creativecommons org licenses by nc nd [1234] [05]
70 ofl-1.1 | scripts sil org | (?:http|https) scripts sil org ofl
70 odbl | opendatacommons org | (?:http|https) (?:www )?opendatacommons org licenses odbl(?: 1 0)?
70 odc-by | opendatacommons org | (?:http|https) (?:www )?opendatacommons org licenses by(?: 1 0)?
70 pddl | opendatacommons org | (?:http|https) (?:www )?opendatacommons org licenses pddl(?: 1 0)?
70 python | docs python org | (?:http|https) docs python org (?:3 )?license(?: html)?
70 php | php net license | (?:http|https) (?:www )?php net license(?: 3 01)?(?: txt)?
60 apache-2.0 | apache license | apache license (?:version |v )?2 0
60 apache-2.0 | apache software license | apache software license (?:version |v )?2 0
60 apache-1.1 | apache | apache (?:software )?license (?:version |v )?1 1
60 gpl-1.0 | general public license | gnu general public license (?:version |v )?1(?: 0)?
60 gpl-2.0 | general public license | gnu general public license (?:version |v ?)?2(?: 0)?(?: or later| only)?
60 gpl-3.0 | general public license | gnu general public license (?:version |v ?)?3(?: 0)?(?: or later| only)?
60 lgpl-2.0 | library general public license | gnu library general public license (?:version |v ?)?2(?: 0)?
60 lgpl-2.1 | lesser general public license | gnu lesser general public license (?:version |v ?)?2 1(?: or later| only)?
60 lgpl-3.0 | lesser general public license | gnu lesser general public license (?:version |v ?)?3(?: 0)?(?: or later| only)?
60 agpl-3.0 | affero general public license | gnu affero general public license (?:version |v ?)?3(?: 0)?(?: or later| only)?
60 gfdl-1.2 | free documentation license | gnu free documentation license (?:version |v )?1 2
60 gfdl-1.3 | free documentation license | gnu free documentation license (?:version |v )?1 3
60 mpl-1.0 | mozilla public license | mozilla public license (?:version |v )?1 0
60 mpl-1.1 | mozilla public license | mozilla public license (?:version |v )?1 1
60 mpl-2.0 | mozilla public license | mozilla public license (?:version |v )?2 0
60 epl-1.0 | eclipse public license | eclipse public license (?:version |v )?1 0
60 epl-2.0 | eclipse public license | eclipse public license (?:version |v )?2 0
60 edl-1.0 | eclipse distribution license | eclipse distribution license (?:version |v )?1 0
60 cddl-1.0 | common development and distribution license | common development and distribution license(?: cddl)? (?:version |v )?1 0
60 cddl-1.1 | common development and distribution license | common development and distribution license(?: cddl)? (?:version |v )?1 1
60 eupl-1.1 | european union public licen | european union public licen[cs]e (?:version |v )?1 1
60 eupl-1.2 | european union public licen | european union public licen[cs]e (?:version |v )?1 2
60 osl-3.0 | open software license | open software license (?:version |v )?3 0
60 afl-2.1 | academic free license | academic free license (?:version |v )?2 1
60 afl-3.0 | academic free license | academic free license (?:version |v )?3 0
60 artistic-1.0 | artistic license | artistic license (?:version |v )?1 0
60 artistic-2.0 | artistic license | artistic license (?:version |v )?2 0
60 bsl-1.0 | boost software license | boost software license (?:version |v )?1 0
60 busl-1.1 | business source license | business source license (?:version |v )?1 1
60 ofl-1.1 | open font license | (?:sil )?open font license (?:version |v )?1 1
60 php-3.01 | php license | php license (?:version |v )?3 01
60 zpl-2.1 | zope public license | zope public license (?:zpl )?(?:version |v )?2 1
60 ecl-2.0 | educational community license | educational community license (?:version |v )?2 0
60 lppl-1.3c | latex project public license | latex project public license (?:version |v )?1 3(?: ?[abc])?
60 cc-by-4.0 | creative commons attribution | creative commons attribution 4 0(?: international)?
60 cc-by-3.0 | creative commons attribution | creative commons attribution 3 0(?: unported)?
60 cc-by-2.0 | creative commons attribution | creative commons attribution 2 [05](?: generic)?
60 cc-by-sa-4.0 | creative commons attribution | creative commons attribution share ?alike 4 0(?: international)?
60 cc-by-sa-3.0 | creative commons attribution | creative commons attribution share ?alike 3 0(?: unported)?
60 cc-by-sa-2.0 | creative commons attribution | creative commons attribution share ?alike 2 [05](?: generic)?
60 cc-by-nc-4.0 | creative commons attribution | creative commons attribution non ?commercial 4 0(?: international)?
60 cc-by-nc-3.0 | creative commons attribution | creative commons attribution non ?commercial 3 0(?: unported)?
60 cc-by-nd-4.0 | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
60 cc-by-nc-sa-4.0 | creative commons attribution | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
60 cc-by-nc-sa-3.0 | creative commons attribution | creative commons attribution non ?commercial share ?alike 3 0(?: unported)?
60 cc-by-nc-nd-4.0 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
60 cc-by-nc-nd-3.0 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s 3 0(?: unported)?
60 cc-by | cc by | cc by [1234] [05]
60 cc-by-sa | cc by sa | cc by sa [1234] [05]
60 cc-by-nc | cc by nc | cc by nc [1234] [05]
60 cc-by-nd | cc by nd | cc by nd [1234] [05]
60 cc-by-nc-sa | cc by nc sa | cc by nc sa [1234] [05]
60 cc-by-nc-nd | cc by nc nd | cc by nc nd [1234] [05]
60 cc0-1.0 | cc0 | cc0 1 0(?: universal)?
50 gpl | general public license | gnu general public license
50 gpl | gnu gpl | gnu gpl
50 lgpl | lesser general public license | gnu lesser general public license
50 lgpl | library general public license | gnu library general public license
50 lgpl | gnu lgpl | gnu lgpl
50 agpl | affero general public license | (?:gnu )?affero general public license
50 agpl | gnu agpl | gnu agpl
50 gfdl | free documentation license | gnu free documentation license
50 apache | apache license | apache license
50 apache | apache software license | apache software license
50 mit | mit license | mit license
50 mit | mit licence | mit licence
50 mit | expat license | expat license
50 x11 | x11 license | x11 license
50 bsd | bsd license | bsd license
50 bsd | bsd licence | bsd licence
50 bsd | berkeley software distribution | berkeley software distribution license
50 bsd-2-clause | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) license
50 bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) license
50 bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd) license
50 isc | isc licen | isc licen[cs]e
50 zlib | zlib | zlib(?: libpng)? license
50 mpl | mozilla public license | mozilla public license
50 epl | eclipse public license | eclipse public license
50 cddl | common development and distribution license | common development and distribution license
50 cpl | common public license | common public license
50 ipl | ibm public license | ibm public license
50 eupl | european union public licen | european union public licen[cs]e
50 osl | open software license | open software license
50 afl | academic free license | academic free license
50 artistic | artistic license | (?:perl |the )?artistic license
50 bsl | boost software license | boost software license
50 busl | business source license | business source license
50 python | python software foundation license | python software foundation license
50 psf | psf license | psf license
50 php | php license | php license
50 ruby | ruby | ruby(?: s)? license
50 postgresql | postgresql | postgresql licen[cs]e
50 openssl | openssl license | openssl license
50 ofl | open font license | (?:sil )?open font license
50 ncsa | ncsa | ncsa open source license
50 sspl | server side public license | server side public license
50 elastic | elastic license | elastic license
50 commons-clause | commons clause | commons clause
50 wtfpl | wtfpl | wtfpl
50 unlicense | unlicense | the unlicense
50 cc0 | creative commons zero | creative commons zero
50 cc0 | cc0 | cc0
50 cc-by-nc-sa | creative commons attribution | creative commons attribution non ?commercial share ?alike
50 cc-by-nc-nd | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s
50 cc-by-nc | creative commons attribution | creative commons attribution non ?commercial
50 cc-by-sa | creative commons attribution | creative commons attribution share ?alike
50 cc-by-nd | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s
50 cc-by | creative commons attribution | creative commons attribution
50 cc-by-nc-sa | cc by nc sa | cc by nc sa
50 cc-by-nc-nd | cc by nc nd | cc by nc nd
50 cc-by-nc | cc by nc | cc by nc
50 cc-by-sa | cc by sa | cc by sa
50 cc-by-nd | cc by nd | cc by nd
50 odbl | open database license | open database license
50 lppl | latex project public license | latex project public license
50 zpl | zope public license | zope public license
50 ms-pl | microsoft public license | microsoft public license
50 ms-rl | microsoft reciprocal license | microsoft reciprocal license
50 upl | universal permissive license | universal permissive license
50 beerware | beerware | beerware(?: license)?
40 apache-2.0 | apache 2 | apache 2(?: 0)?
40 apache-2.0 | apache v2 | apache v2
40 apache-2.0 | asl 2 | asl 2 0
40 gpl-1.0 | gpl | gpl (?:version |v )?1(?: 0)?(?: or later| only)?
40 gpl-2.0 | gpl | gpl (?:version |v ?)?2(?: 0)?(?: or later| only)?
40 gpl-3.0 | gpl | gpl (?:version |v ?)?3(?: 0)?(?: or later| only)?
40 gpl-2.0 | gplv2 | gplv2(?: or later| only)?
40 gpl-3.0 | gplv3 | gplv3(?: or later| only)?
40 lgpl-2.1 | lgpl | lgpl (?:version |v ?)?2 1(?: or later| only)?
40 lgpl-3.0 | lgpl | lgpl (?:version |v ?)?3(?: 0)?(?: or later| only)?
40 lgpl-2.1 | lgplv2 | lgplv2(?: 1)?(?: or later| only)?
40 lgpl-3.0 | lgplv3 | lgplv3(?: or later| only)?
40 agpl-3.0 | agpl | agpl (?:version |v ?)?3(?: 0)?(?: or later| only)?
40 agpl-3.0 | agplv3 | agplv3(?: or later| only)?
40 mpl-1.1 | mpl | mpl (?:version |v )?1 1
40 mpl-2.0 | mpl | mpl (?:version |v )?2(?: 0)?
40 epl-1.0 | epl | epl (?:version |v )?1 0
40 epl-2.0 | epl | epl (?:version |v )?2 0
40 cddl-1.0 | cddl | cddl (?:version |v )?1 [01]
40 eupl | eupl | eupl (?:version |v )?1 [12]
40 bsd-2-clause | bsd 2 clause | bsd 2 clause
40 bsd-3-clause | bsd 3 clause | bsd 3 clause
40 bsd-4-clause | bsd 4 clause | bsd 4 clause
40 bsd-2-clause | 2 clause bsd | 2 clause bsd
40 bsd-3-clause | 3 clause bsd | 3 clause bsd
40 bsl-1.0 | bsl 1 0 | bsl 1 0
40 ofl-1.1 | ofl 1 1 | ofl 1 1
30 mit | mit | licen[cs]e mit
30 gpl | gpl | licen[cs]e gpl
30 bsd | bsd | licen[cs]e bsd
30 apache | apache | licen[cs]e apache
30 isc | isc | licen[cs]e isc
30 lgpl | lgpl | lgpl
30 agpl | agpl | agpl
30 cddl | cddl | cddl
30 eupl | eupl | eupl
30 odbl | odbl | odbl
30 gpl | gpl | gpl
30 copyleft | copyleft | copyleft
30 open-source | open source licen | (?:an )?open source licen[cs]e
30 proprietary | all rights reserved | all rights reserved
30 proprietary | proprietary license | proprietary license
30 proprietary | commercial license | commercial license
30 freeware | freeware | freeware
30 shareware | shareware | shareware
"""
