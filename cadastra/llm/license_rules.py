"""Signature rules for license mentions, on texts of lower-case words with one space between them.

A rule's keyword is a word that each of its matches holds; a text without it isn't searched. A larger
priority wins over what it contains. Families list full statements first, then names, then hints.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Words stand between single spaces; a rule matches whole words only.
NUMBER = "[0-9]+( [0-9]+)?"


@dataclass(frozen=True)
class SignatureRule:
    label: str
    keyword: str
    pattern: str
    priority: int  # 3 statement, 2 name, 1 hint
    order: int = 0

    @property
    def regex(self) -> str:
        return f"(?<= )(?:{self.pattern})(?= )"


def _family(label: str, keyword: str, statements: str = "", names: str = "", hints: str = "") -> list[SignatureRule]:
    """Patterns are one to a line; a keyword of its own may stand before ``::``."""
    out = []
    for priority, block in ((3, statements), (2, names), (1, hints)):
        for line in filter(None, map(str.strip, block.splitlines())):
            own, _, pattern = line.rpartition("::")
            out.append(SignatureRule(label, own.strip() or keyword, pattern.strip(), priority))
    return out


_RULES = [
    *_family("mit", "mit", """
        (released|licensed|distributed|available|published) under (the )?mit( license)?
        (released|licensed|distributed|available) under the terms of the mit license
        this (software|project|work|code) is (licensed|released) under the mit license
        permission:: permission is hereby granted free of charge to any person obtaining a copy of this software
        warranty:: the software is provided as is without warranty of any kind express or implied
        """, """
        the mit license( mit)?
        mit license
        mit licence
        expat:: expat license
        x11:: x11 license
        spdx:: spdx license identifier mit
        """, """
        mit licensed
        mit style license
        """),
    *_family("apache-2", "apache", f"""
        licensed under the apache license( version 2( 0)?)?
        (released|distributed|available) under (the )?apache (license|licence)( version)?( 2( 0)?)?
        compliance:: you may not use this file except in compliance with the license
        apache:: apache license version 2 0 january 2004
        obtain a copy of the license at http www apache org licenses license 2 0
        """, """
        apache license( version)? 2( 0)?
        apache software license( version)? 2( 0)?
        apache public license( version)? 2( 0)?
        apache 2( 0)?( license| licence)?
        asl:: asl 2 0
        spdx:: spdx license identifier apache 2 0
        """, """
        apache licensed
        apache style license
        """),
    *_family("apache-1", "apache", """
        licensed under the apache (software )?license version 1( [01])?
        """, """
        apache (software )?license( version)? 1( [01])?
        spdx:: spdx license identifier apache 1 [01]
        """),
    *_family("gpl-3", "gnu", """
        (work|program|software|file) is licensed under the gnu general public license version 3( 0)?( or later)?
        licensed under the gnu general public license version 3( 0)?( or later)?
        option:: either version 3 of the license or at your option any later version
        gnu general public license as published by the free software foundation version 3
        """, """
        gnu general public license version 3( 0)?
        gnu general public license v3( 0)?
        gnu gpl v?3( 0)?
        gplv3:: gplv3
        gpl:: gpl v?3( 0)?( or later)?
        spdx:: spdx license identifier gpl 3 0( only| or later)?
        """),
    *_family("gpl-2", "gnu", """
        (work|program|software|file) is licensed under the gnu general public license version 2( 0)?( or later)?
        licensed under the gnu general public license version 2( 0)?( or later)?
        option:: either version 2 of the license or at your option any later version
        gnu general public license as published by the free software foundation version 2
        """, """
        gnu general public license version 2( 0)?
        gnu general public license v2( 0)?
        gnu gpl v?2( 0)?
        gplv2:: gplv2
        gpl:: gpl v?2( 0)?( or later)?
        spdx:: spdx license identifier gpl 2 0( only| or later)?
        """),
    *_family("gpl", "gnu", f"""
        (this )?(work|program|software|file) is licensed under the gnu general public license( version {NUMBER})?
        (released|distributed|available) under the (terms of the )?gnu general public license
        redistribute:: redistribute it and or modify it under the terms of the gnu general public license
        """, """
        gnu general public license
        gnu general public licence
        general:: general public license
        gnu gpl
        """, """
        gpl:: gpl licensed
        gpl:: gpl compatible
        copyleft:: copyleft license
        """),
    *_family("lgpl", "lesser", f"""
        general:: licensed under the gnu (lesser|library) general public license( version {NUMBER})?
        lesser:: redistribute it and or modify it under the terms of the gnu lesser general public license
        """, f"""
        gnu lesser general public license( version {NUMBER})?
        library:: gnu library general public license( version {NUMBER})?
        lesser general public license
        lgpl:: (gnu )?lgpl( v?{NUMBER})?
        lgplv2:: lgplv2( 1)?
        lgplv3:: lgplv3
        spdx:: spdx license identifier lgpl [23] [01]( only| or later)?
        """),
    *_family("agpl", "affero", f"""
        licensed under the gnu affero general public license( version {NUMBER})?
        """, f"""
        gnu affero general public license( version {NUMBER})?
        affero general public license
        agpl:: (gnu )?agpl( v?{NUMBER})?
        agplv3:: agplv3
        spdx:: spdx license identifier agpl 3 0( only| or later)?
        """),
    *_family("gfdl", "documentation", f"""
        copied:: may be copied distributed and or modified under the terms of the gnu free documentation license
        """, f"""
        gnu free documentation license( version {NUMBER})?
        gfdl:: gfdl( {NUMBER})?
        spdx:: spdx license identifier gfdl 1 [123]
        """),
    *_family("bsd-2", "bsd", """
        simplified:: licensed under the simplified bsd license
        licensed under the bsd 2 clause license
        """, """
        bsd 2 clause( license)?
        2 clause bsd( license)?
        two clause bsd( license)?
        simplified bsd license
        freebsd:: freebsd license
        spdx:: spdx license identifier bsd 2 clause
        """),
    *_family("bsd-3", "bsd", """
        licensed under the bsd 3 clause license
        neither:: neither the name of (the )?([^ ]+ ){1,8}nor the names of its contributors
        """, """
        bsd 3 clause( license)?
        3 clause bsd( license)?
        three clause bsd( license)?
        new bsd license
        modified bsd license
        revised bsd license
        spdx:: spdx license identifier bsd 3 clause
        """),
    *_family("bsd-4", "bsd", """
        advertising:: all advertising materials mentioning features or use of this software
        """, """
        bsd 4 clause( license)?
        4 clause bsd( license)?
        original bsd license
        spdx:: spdx license identifier bsd 4 clause
        """),
    *_family("bsd", "bsd", """
        redistribution:: redistribution and use in source and binary forms with or without modification are permitted
        (released|licensed|distributed) under (the |a )?bsd license
        """, """
        bsd license
        bsd licence
        """, """
        bsd licensed
        bsd style license
        """),
    *_family("0bsd", "0bsd", "", """
        0bsd( license)?
        clause:: zero clause bsd( license)?
        spdx:: spdx license identifier 0bsd
        """),
    *_family("isc", "isc", """
        purpose:: permission to use copy modify and or distribute this software for any purpose
        (released|licensed|distributed) under the isc license
        """, """
        isc license
        isc licence
        spdx:: spdx license identifier isc
        """),
    *_family("mpl-2", "mozilla", """
        subject to the terms of the mozilla public license (v|version )?2( 0)?
        """, """
        mozilla public license( version| v)? ?2( 0)?
        mpl:: mpl v?2( 0)?
        spdx:: spdx license identifier mpl 2 0
        """),
    *_family("mpl-1", "mozilla", """
        subject to the mozilla public license version 1 1
        """, """
        mozilla public license( version)? 1( [01])?
        mpl:: mpl 1 [01]
        spdx:: spdx license identifier mpl 1 [01]
        """),
    *_family("mpl", "mozilla", "", """
        mozilla public license
        mozilla public licence
        """),
    *_family("epl", "eclipse", f"""
        made available under the terms of the eclipse public license( v?{NUMBER})?
        """, f"""
        eclipse public license( version| v)?( {NUMBER})?
        eclipse distribution license( v?{NUMBER})?
        epl:: epl {NUMBER}
        spdx:: spdx license identifier epl [12] 0
        """),
    *_family("cddl", "distribution", f"""
        common development and distribution license the license
        """, f"""
        common development and distribution license( version)?( {NUMBER})?
        cddl:: cddl( {NUMBER})?
        spdx:: spdx license identifier cddl 1 [01]
        """),
    *_family("cpl", "common", "", f"""
        common public license( version)?( {NUMBER})?
        spdx:: spdx license identifier cpl 1 0
        """),
    *_family("eupl", "european", """
        licensed under the european union public licen[cs]e
        """, f"""
        european union public licen[cs]e( v?{NUMBER})?
        eupl:: eupl( v?{NUMBER})?
        spdx:: spdx license identifier eupl 1 [012]
        """),
    *_family("cc0", "cc0", """
        waived:: waived all copyright and related or neighboring rights
        released under cc0
        """, """
        cc0( 1 0)?( universal)?
        zero:: creative commons zero
        public domain dedication:: cc0 public domain dedication
        spdx:: spdx license identifier cc0 1 0
        """),
    *_family("cc-by", "cc", f"""
        licensed under (a |the )?cc by( {NUMBER})?
        commons:: licensed under a creative commons attribution( {NUMBER})?( international)? license
        """, f"""
        cc by( {NUMBER})?
        attribution:: creative commons attribution( {NUMBER})?( international)?( license)?
        spdx:: spdx license identifier cc by [1234] 0
        """),
    *_family("cc-by-sa", "cc", f"""
        licensed under (a |the )?cc by sa( {NUMBER})?
        """, f"""
        cc by sa( {NUMBER})?
        sharealike:: creative commons attribution sharealike( {NUMBER})?( international)?( license)?
        alike:: creative commons attribution share alike( {NUMBER})?
        spdx:: spdx license identifier cc by sa [1234] 0
        """),
    *_family("cc-by-nc", "cc", f"""
        licensed under (a |the )?cc by nc( {NUMBER})?
        """, f"""
        cc by nc( {NUMBER})?
        noncommercial:: creative commons attribution noncommercial( {NUMBER})?( international)?( license)?
        commercial:: creative commons attribution non commercial( {NUMBER})?
        spdx:: spdx license identifier cc by nc [1234] 0
        """),
    *_family("cc-by-nd", "cc", f"""
        licensed under (a |the )?cc by nd( {NUMBER})?
        """, f"""
        cc by nd( {NUMBER})?
        noderivatives:: creative commons attribution noderivatives( {NUMBER})?
        noderivs:: creative commons attribution noderivs( {NUMBER})?
        spdx:: spdx license identifier cc by nd [1234] 0
        """),
    *_family("cc-by-nc-sa", "cc", f"""
        licensed under (a |the )?cc by nc sa( {NUMBER})?
        """, f"""
        cc by nc sa( {NUMBER})?
        sharealike:: creative commons attribution noncommercial sharealike( {NUMBER})?
        spdx:: spdx license identifier cc by nc sa [1234] 0
        """),
    *_family("cc-by-nc-nd", "cc", f"""
        licensed under (a |the )?cc by nc nd( {NUMBER})?
        """, f"""
        cc by nc nd( {NUMBER})?
        noderivatives:: creative commons attribution noncommercial noderivatives( {NUMBER})?
        spdx:: spdx license identifier cc by nc nd [1234] 0
        """),
    *_family("creative-commons", "commons", """
        licensed under (a |the )?creative commons license
        """, """
        creative commons( license| licence)?
        """),
    *_family("public-domain", "domain", """
        (released|placed|dedicated) (into|in|to) the public domain
        """, """
        public domain dedication
        """, """
        in the public domain
        """),
    *_family("unlicense", "unlicense", """
        unencumbered:: this is free and unencumbered software released into the public domain
        """, """
        the unlicense
        unlicense
        spdx:: spdx license identifier unlicense
        """),
    *_family("wtfpl", "wtfpl", """
        fuck:: do what the fuck you want to public license
        """, """
        wtfpl
        spdx:: spdx license identifier wtfpl
        """),
    *_family("zlib", "zlib", """
        arising:: in no event will the authors be held liable for any damages arising from the use of this software
        """, """
        zlib license
        zlib libpng license
        spdx:: spdx license identifier zlib
        """),
    *_family("boost", "boost", """
        distributed under the boost software license( version 1 0)?
        """, """
        boost software license( version 1 0)?
        boost license
        spdx:: spdx license identifier bsl 1 0
        """),
    *_family("artistic", "artistic", "", f"""
        (perl )?artistic license( {NUMBER})?
        same terms as perl itself:: under the same terms as perl itself
        spdx:: spdx license identifier artistic [12] 0
        """),
    *_family("psf", "python", "", f"""
        python software foundation license( version {NUMBER})?
        psf:: psf license
        spdx:: spdx license identifier (psf|python) 2 0
        """),
    *_family("ofl", "font", "", f"""
        sil open font license( version)?( {NUMBER})?
        open font license
        ofl:: ofl 1 1
        spdx:: spdx license identifier ofl 1 1
        """),
    *_family("odbl", "database", "", f"""
        open database license( v?{NUMBER})?
        odbl:: odbl( {NUMBER})?
        spdx:: spdx license identifier odbl 1 0
        """),
    *_family("odc-by", "data", "", """
        open data commons attribution license
        odc:: odc by( 1 0)?
        """),
    *_family("pddl", "data", "", """
        open data commons public domain dedication and licen[cs]e
        pddl:: pddl( 1 0)?
        """),
    *_family("ncsa", "ncsa", "", """
        university of illinois ncsa open source license
        ncsa (open source )?license
        spdx:: spdx license identifier ncsa
        """),
    *_family("ms-pl", "microsoft", "", """
        microsoft public license( ms pl)?
        microsoft reciprocal license( ms rl)?
        spdx:: spdx license identifier ms [pr]l
        """),
    *_family("openssl", "openssl", """
        openssl:: this product includes software developed by the openssl project
        """, """
        openssl license
        spdx:: spdx license identifier openssl
        """),
    *_family("php", "php", "", f"""
        php license( version)?( {NUMBER})?
        spdx:: spdx license identifier php 3 0
        """),
    *_family("ruby", "ruby", "", """
        ruby license
        spdx:: spdx license identifier ruby
        """),
    *_family("postgresql", "postgresql", "", """
        postgresql license
        spdx:: spdx license identifier postgresql
        """),
    *_family("w3c", "w3c", "", """
        w3c software( notice)?( and)? license
        spdx:: spdx license identifier w3c
        """),
    *_family("upl", "universal", "", f"""
        universal permissive license( v?{NUMBER})?
        spdx:: spdx license identifier upl 1 0
        """),
    *_family("sspl", "server", "", """
        server side public license
        sspl:: sspl( v?1)?
        """),
    *_family("busl", "business", "", f"""
        business source license( {NUMBER})?
        spdx:: spdx license identifier busl 1 1
        """),
    *_family("elastic", "elastic", "", f"""
        elastic license( {NUMBER})?
        """),
    *_family("openrail", "rail", "", """
        (creativeml )?open rail( m)?( license)?
        openrail:: (creativeml |bigcode )?openrail( m)?( license)?
        """),
    *_family("proprietary", "rights", """
        all rights reserved no part of this ([^ ]+ ){1,4}may be reproduced
        unauthorized:: unauthorized (copying|reproduction|distribution) of this ([^ ]+ ){0,3}is (strictly )?prohibited
        proprietary:: proprietary and confidential
        """, """
        all rights reserved
        """),
    *_family("copyright", "copyright", "", """
        copyright (c )?(19|20)[0-9][0-9]( (19|20)[0-9][0-9])?
        """, """
        copyright notice
        """),
]

RULES = tuple(SignatureRule(r.label, r.keyword.split(" ")[0], r.pattern, r.priority, i) for i, r in enumerate(_RULES))
