"""The signature rules of the license scan, in order: label, keyword, priority, confidence, regex.

A regex is matched against whole words (A-Z lower-cased, other ASCII signs taken as spaces), so
"Version 2.0" reads "version 2 0" and an address reads as its parts.  The keyword is a run of
whole words that every match of the regex contains, or several such runs joined by &; a rule
is tried only where they occur.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    confidence: float
    regex: str
    base: bool = False


#: The base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

RULES = [Rule(label, phrase, 100, 1.0, phrase, True) for phrase, label in BASE] + [
    Rule(*r)
    for r in [
        # MIT and its relatives
        ("mit", "permission is hereby granted", 88, 1.0, "permission is hereby granted free of charge to any person obtaining a copy(?: of this software(?: and associated documentation files)?)?"),
        ("mit", "substantial portions of the software", 86, 0.9, "shall be included in all copies or substantial portions of the software"),
        ("mit", "identifier mit", 85, 1.0, "spdx license identifier mit"),
        ("mit", "mit&under", 75, 0.95, "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |an )?(?:terms of the )?mit(?: x11)? licen[cs]e"),
        ("mit", "licenses mit", 75, 0.95, "opensource org licenses mit(?: license)?(?: php| html)?"),
        ("mit", "expat", 60, 0.9, "expat licen[cs]e"),
        ("mit", "x11", 60, 0.85, "(?:mit )?x11 (?:style )?licen[cs]e"),
        ("mit", "mit&license", 55, 0.8, "mit(?: style)? license"),
        ("mit", "mit&licence", 55, 0.8, "mit(?: style)? licence"),
        ("mit", "license&mit", 50, 0.7, "license(?: is)? mit"),
        ("mit-0", "mit no attribution", 70, 0.95, "mit no attribution(?: licen[cs]e)?"),
        ("mit-0", "mit 0", 70, 0.9, "(?:spdx license identifier |licen[cs]e )mit 0"),
        # Apache
        ("apache-2", "identifier apache", 90, 1.0, "spdx license identifier apache 2 0"),
        ("apache-2", "apache&under", 80, 0.95, "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |an )?(?:terms of the )?apache(?: software)?(?: licen[cs]e)? (?:version |v ?)?2(?: 0)?"),
        ("apache-2", "licenses license 2 0", 78, 0.95, "(?:www )?apache org licenses license 2 0(?: txt| html)?"),
        ("apache-2", "apache", 70, 0.9, "apache(?: software)? (?:public )?licen[cs]e (?:version |v ?)?2(?: 0)?"),
        ("apache-2", "apache", 60, 0.85, "apache(?: software)? (?:version |v ?)?2(?: 0)?(?: licen[cs]e)"),
        ("apache-2", "asl 2", 60, 0.8, "(?:the )?asl 2 0"),
        ("apache-1.1", "identifier apache", 90, 1.0, "spdx license identifier apache 1 1"),
        ("apache-1.1", "apache software license", 72, 0.9, "apache software license (?:version |v ?)?1 1"),
        ("apache-1.1", "software developed by the apache", 86, 0.9, "this product includes software developed by the apache (?:software foundation|group)"),
        ("apache-1", "apache license", 69, 0.85, "apache license (?:version |v ?)?1(?: 0)?"),
        ("apache", "apache", 45, 0.7, "apache(?: software| style)? licen[cs]e"),
        # BSD
        ("bsd", "redistribution and use", 88, 1.0, "redistribution and use in source and binary forms with or without modification(?: are permitted)?"),
        ("bsd-3-clause", "to endorse or promote products", 89, 1.0, "(?:neither the names? of|the names? of) [a-z0-9 ]{1,60} (?:to endorse or promote products|may be used to endorse or promote products)"),
        ("bsd-4-clause", "all advertising materials", 89, 1.0, "all advertising materials mentioning features or use of this software must display"),
        ("bsd-2-clause", "identifier bsd 2", 85, 1.0, "spdx license identifier bsd 2 clause(?: patent| views)?"),
        ("bsd-3-clause", "identifier bsd 3", 85, 1.0, "spdx license identifier bsd 3 clause(?: clear| attribution)?"),
        ("bsd-4-clause", "identifier bsd 4", 85, 1.0, "spdx license identifier bsd 4 clause(?: uc)?"),
        ("bsd-2-clause", "2 clause", 65, 0.9, "(?:bsd 2 clause|2 clause bsd)(?: licen[cs]e)?"),
        ("bsd-2-clause", "simplified bsd", 65, 0.9, "simplified bsd licen[cs]e"),
        ("bsd-2-clause", "freebsd", 60, 0.85, "freebsd (?:documentation )?licen[cs]e"),
        ("bsd-3-clause", "3 clause", 65, 0.9, "(?:bsd 3 clause|3 clause bsd)(?: licen[cs]e)?"),
        ("bsd-3-clause", "new bsd", 65, 0.9, "new bsd licen[cs]e"),
        ("bsd-3-clause", "modified bsd", 65, 0.9, "modified bsd licen[cs]e"),
        ("bsd-3-clause", "revised bsd", 65, 0.9, "revised bsd licen[cs]e"),
        ("bsd-4-clause", "4 clause", 65, 0.9, "(?:bsd 4 clause|4 clause bsd)(?: licen[cs]e)?"),
        ("bsd-4-clause", "original bsd", 65, 0.9, "original bsd licen[cs]e"),
        ("0bsd", "0bsd", 70, 0.9, "(?:spdx license identifier 0bsd|0bsd licen[cs]e|bsd 0bsd)"),
        ("0bsd", "zero clause", 70, 0.9, "(?:bsd zero clause|zero clause bsd)(?: licen[cs]e)?"),
        ("bsd", "bsd&under", 75, 0.9, "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |an? )?(?:terms of the )?bsd(?: style)? licen[cs]e"),
        ("bsd", "bsd", 55, 0.8, "bsd(?: style)? licen[cs]e"),
        # GNU general public licenses
        ("gpl", "redistribute it and or modify", 88, 1.0, "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
        ("gpl-2", "general public license", 90, 1.0, "gnu general public license as published by the free software foundation (?:either )?version 2"),
        ("gpl-3", "general public license", 90, 1.0, "gnu general public license as published by the free software foundation (?:either )?version 3"),
        ("gpl-2", "identifier gpl 2", 90, 1.0, "spdx license identifier gpl 2 0(?: only| or later)?"),
        ("gpl-3", "identifier gpl 3", 90, 1.0, "spdx license identifier gpl 3 0(?: only| or later)?"),
        ("gpl-2", "gpl&under", 80, 0.95, "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |an? )?(?:terms of the )?(?:gnu )?gpl(?: licen[cs]e)? (?:version |v ?)?2(?: 0)?(?: only| or later)?"),
        ("gpl-2", "general public&under", 80, 0.95, "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |an? )?(?:terms of the )?(?:gnu )?general public(?: licen[cs]e)? (?:version |v ?)?2(?: 0)?(?: only| or later)?"),
        ("gpl-3", "gpl&under", 80, 0.95, "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |an? )?(?:terms of the )?(?:gnu )?gpl(?: licen[cs]e)? (?:version |v ?)?3(?: 0)?(?: only| or later)?"),
        ("gpl-3", "general public&under", 80, 0.95, "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |an? )?(?:terms of the )?(?:gnu )?general public(?: licen[cs]e)? (?:version |v ?)?3(?: 0)?(?: only| or later)?"),
        ("gpl-2", "general public license", 70, 0.9, "(?:gnu )?general public license (?:version |v ?)?2(?: 0)?(?: only| or later)?"),
        ("gpl-3", "general public license", 70, 0.9, "(?:gnu )?general public license (?:version |v ?)?3(?: 0)?(?: only| or later)?"),
        ("gpl-2", "gpl", 60, 0.85, "(?:gnu )?gpl (?:version |v ?)?2(?: 0)?(?: only| or later| licen[cs]e)"),
        ("gpl-3", "gpl", 60, 0.85, "(?:gnu )?gpl (?:version |v ?)?3(?: 0)?(?: only| or later| licen[cs]e)"),
        ("gpl-2", "gplv2", 60, 0.85, "gplv2(?: only| or later)?"),
        ("gpl-3", "gplv3", 60, 0.85, "gplv3(?: only| or later)?"),
        ("gpl", "gpl&under", 75, 0.9, "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |an? )?(?:terms of the )?(?:gnu )?gpl licen[cs]e"),
        ("gpl", "gnu general public&under", 75, 0.9, "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |an? )?(?:terms of the )?gnu general public licen[cs]e"),
        ("gpl", "gnu org licenses", 72, 0.9, "gnu org licenses (?:old licenses )?gpl(?: 2 0| 3 0)?(?: html| txt)"),
        ("gpl", "gpl", 50, 0.75, "(?:gnu )?gpl licen[cs]e"),
        ("gpl", "gnu general public", 55, 0.8, "gnu general public licen[cs]e"),
        ("gpl-classpath", "classpath exception", 70, 0.9, "(?:with )?(?:the )?(?:gnu )?classpath exception(?: 2 0)?"),
        ("gpl", "linking exception", 40, 0.6, "gpl linking exception|linking exception to the (?:gnu )?gpl"),
        # GNU lesser, affero and documentation licenses
        ("lgpl-2.1", "identifier lgpl 2", 90, 1.0, "spdx license identifier lgpl 2 1(?: only| or later)?"),
        ("lgpl-3", "identifier lgpl 3", 90, 1.0, "spdx license identifier lgpl 3 0(?: only| or later)?"),
        ("lgpl-2.1", "lesser general public", 82, 0.95, "(?:gnu )?lesser general public license (?:as published by the free software foundation either )?(?:version |v ?)?2 1(?: only| or later)?"),
        ("lgpl-3", "lesser general public", 82, 0.95, "(?:gnu )?lesser general public license (?:as published by the free software foundation either )?(?:version |v ?)?3(?: 0)?(?: only| or later)?"),
        ("lgpl-2", "library general public", 82, 0.95, "(?:gnu )?library general public license(?: (?:version |v ?)?2(?: 0)?)?"),
        ("lgpl-2.1", "lgpl", 62, 0.9, "(?:gnu )?lgpl (?:version |v ?)?2 1(?: only| or later)?"),
        ("lgpl-3", "lgpl", 62, 0.9, "(?:gnu )?lgpl (?:version |v ?)?3(?: 0)?(?: only| or later| licen[cs]e)"),
        ("lgpl-2.1", "lgplv2", 62, 0.9, "lgplv2(?: 1)?(?: only| or later)?"),
        ("lgpl-3", "lgplv3", 62, 0.9, "lgplv3(?: only| or later)?"),
        ("lgpl", "lesser general public", 57, 0.85, "(?:gnu )?lesser general public licen[cs]e"),
        ("lgpl", "lgpl", 55, 0.8, "(?:gnu )?lgpl licen[cs]e"),
        ("agpl-3", "identifier agpl 3", 90, 1.0, "spdx license identifier agpl 3 0(?: only| or later)?"),
        ("agpl-3", "affero", 82, 0.95, "(?:gnu )?affero general public license (?:as published by the free software foundation either )?(?:version |v ?)?3(?: 0)?(?: only| or later)?"),
        ("agpl-3", "agpl", 62, 0.9, "(?:gnu )?agpl (?:version |v ?)?3(?: 0)?(?: only| or later| licen[cs]e)"),
        ("agpl-3", "agplv3", 62, 0.9, "agplv3(?: only| or later)?"),
        ("agpl", "affero", 57, 0.85, "(?:gnu )?affero general public licen[cs]e"),
        ("agpl", "agpl", 55, 0.8, "(?:gnu )?agpl licen[cs]e"),
        ("gfdl", "free documentation license", 70, 0.9, "gnu free documentation license(?: (?:version |v ?)?1 [123])?"),
        ("gfdl", "identifier gfdl", 85, 1.0, "spdx license identifier gfdl 1 [123](?: only| or later)?"),
        # Mozilla, Eclipse, European Union and other file-level copyleft
        ("mpl-2", "subject to the terms of the mozilla", 88, 1.0, "this source code form is subject to the terms of the mozilla public license(?: v ?2 0| version 2 0)?"),
        ("mpl-1.1", "subject to the mozilla", 88, 1.0, "the contents of this file are subject to the mozilla public license version 1 1"),
        ("mpl-2", "identifier mpl 2", 90, 1.0, "spdx license identifier mpl 2 0(?: no copyleft exception)?"),
        ("mpl-1.1", "identifier mpl 1", 90, 1.0, "spdx license identifier mpl 1 1"),
        ("mpl-2", "mozilla public license", 72, 0.9, "mozilla public license (?:version |v ?)?2(?: 0)?"),
        ("mpl-1.1", "mozilla public license", 72, 0.9, "mozilla public license (?:version |v ?)?1 1"),
        ("mpl-2", "mpl", 66, 0.85, "(?:under (?:the |an )?|licen[cs]e )mpl (?:version |v ?)?2(?: 0)?"),
        ("mpl-1.1", "mpl", 66, 0.85, "(?:under (?:the |an )?|licen[cs]e )mpl (?:version |v ?)?1 1"),
        ("mpl-2", "mpl", 60, 0.8, "mpl (?:version |v ?)?2 0(?: licen[cs]e)?"),
        ("mpl", "mozilla public", 52, 0.75, "mozilla public licen[cs]e"),
        ("epl-2", "identifier epl 2", 90, 1.0, "spdx license identifier epl 2 0"),
        ("epl-1", "identifier epl 1", 90, 1.0, "spdx license identifier epl 1 0"),
        ("epl-2", "eclipse public license", 72, 0.9, "eclipse public license (?:version |v ?)?2(?: 0)?"),
        ("epl-1", "eclipse public license", 72, 0.9, "eclipse public license (?:version |v ?)?1(?: 0)?"),
        ("epl-2", "epl", 66, 0.85, "(?:under (?:the |an )?|licen[cs]e )epl (?:version |v ?)?2(?: 0)?"),
        ("epl-1", "epl", 66, 0.85, "(?:under (?:the |an )?|licen[cs]e )epl (?:version |v ?)?1(?: 0)?"),
        ("epl", "eclipse org legal epl", 74, 0.9, "(?:www )?eclipse org legal epl (?:v10|v20|2 0)(?: html| txt)?"),
        ("edl-1", "eclipse distribution license", 70, 0.9, "eclipse distribution license (?:version |v ?)?1(?: 0)?"),
        ("eupl-1.2", "eupl", 68, 0.9, "(?:under (?:the |an )?|identifier |licen[cs]e )eupl (?:version |v ?)?1 2(?: or later)?"),
        ("eupl-1.1", "eupl", 68, 0.9, "(?:under (?:the |an )?|identifier |licen[cs]e )eupl (?:version |v ?)?1 1(?: or later)?"),
        ("eupl-1.2", "european union public", 70, 0.9, "european union public licen[cs]e (?:version |v ?)?1 2"),
        ("eupl", "european union public", 55, 0.8, "european union public licen[cs]e"),
        ("cddl-1", "common development and distribution", 72, 0.9, "common development and distribution license(?: (?:version |v ?)?1 [01])?"),
        ("cddl-1", "cddl", 66, 0.85, "(?:under (?:the |an )?|identifier |licen[cs]e )cddl (?:version |v ?)?1(?: 0| 1)?"),
        ("cpl-1", "common public license", 70, 0.9, "common public license (?:version |v ?)?1(?: 0)?"),
        ("cpl-1", "cpl", 66, 0.85, "(?:under (?:the |an )?|identifier |licen[cs]e )cpl (?:version |v ?)?1(?: 0)?"),
        ("cecill-2.1", "cecill", 68, 0.9, "(?:under (?:the |an )?|identifier )?cecill (?:free software license agreement )?(?:version |v ?)?2 1"),
        ("cecill-b", "cecill b", 68, 0.9, "cecill b(?: licen[cs]e| free software license agreement)?"),
        ("cecill-c", "cecill c", 68, 0.9, "cecill c(?: licen[cs]e| free software license agreement)?"),
        ("ms-pl", "microsoft public license", 70, 0.9, "microsoft public license(?: ms pl)?"),
        ("ms-pl", "identifier ms pl", 85, 1.0, "spdx license identifier ms pl"),
        ("ms-rl", "microsoft reciprocal", 70, 0.9, "microsoft reciprocal license(?: ms rl)?"),
        ("ms-rl", "identifier ms rl", 85, 1.0, "spdx license identifier ms rl"),
        ("apsl-2", "apple public source", 70, 0.9, "apple public source license(?: (?:version |v ?)?2(?: 0)?)?"),
        ("ipl-1", "ibm public license", 70, 0.9, "ibm public license(?: (?:version |v ?)?1(?: 0)?)?"),
        ("qpl-1", "q public license", 70, 0.9, "(?:the )?q public license(?: (?:version |v ?)?1(?: 0)?)?"),
        ("sleepycat", "sleepycat", 60, 0.85, "sleepycat licen[cs]e"),
        ("osl-3", "osl", 66, 0.85, "(?:under (?:the |an )?|identifier |licen[cs]e )osl (?:version |v ?)?3(?: 0)?"),
        ("osl-3", "open software license", 70, 0.9, "open software license (?:version |v ?)?3(?: 0)?"),
        ("afl-3", "academic free license", 70, 0.9, "academic free license (?:version |v ?)?3(?: 0)?"),
        ("afl-3", "afl", 66, 0.85, "(?:under (?:the |an )?|identifier |licen[cs]e )afl (?:version |v ?)?3(?: 0)?"),
        ("rpl-1.5", "reciprocal public license", 70, 0.9, "reciprocal public license(?: (?:version |v ?)?1 5)?"),
        # permissive licenses of projects and institutes
        ("isc", "permission to use copy modify", 88, 1.0, "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee"),
        ("isc", "identifier isc", 85, 1.0, "spdx license identifier isc"),
        ("isc", "isc", 58, 0.85, "(?:under (?:the |an )?)?isc licen[cs]e"),
        ("zlib", "express or implied warranty", 86, 0.9, "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
        ("zlib", "identifier zlib", 85, 1.0, "spdx license identifier zlib"),
        ("zlib", "zlib", 56, 0.85, "zlib(?: libpng)? licen[cs]e"),
        ("libpng", "libpng", 57, 0.85, "libpng licen[cs]e"),
        ("libpng", "png reference library", 57, 0.85, "png reference library(?: licen[cs]e)?"),
        ("bsl-1", "boost software license", 72, 0.95, "boost software license (?:version |v ?)?1(?: 0)?"),
        ("bsl-1", "boost org", 74, 0.95, "(?:www )?boost org license 1 0 txt"),
        ("bsl-1", "bsl", 66, 0.8, "(?:under (?:the |an )?|identifier |licen[cs]e )bsl (?:version |v ?)?1(?: 0)?"),
        ("bsl-1", "boost", 55, 0.8, "boost licen[cs]e"),
        ("unlicense", "unencumbered software", 88, 1.0, "this is free and unencumbered software released into the public domain"),
        ("unlicense", "unlicense", 60, 0.9, "(?:the |identifier )unlicense"),
        ("unlicense", "unlicence", 60, 0.9, "(?:the |identifier )unlicence"),
        ("unlicense", "unlicense org", 74, 0.95, "(?:www )?unlicense org"),
        ("wtfpl", "do what the fuck", 80, 0.95, "do what the fuck you want to public licen[cs]e"),
        ("wtfpl", "wtfpl", 60, 0.9, "wtfpl(?: licen[cs]e| version 2)?"),
        ("postgresql", "postgresql", 58, 0.85, "postgresql licen[cs]e"),
        ("python-2", "python software foundation license", 72, 0.9, "python software foundation license(?: (?:version |v ?)?2(?: 0)?)?"),
        ("python-2", "psf", 66, 0.85, "(?:under (?:the |an )?|identifier |licen[cs]e )psf(?: licen[cs]e| 2 0)(?: 2 0| version 2)?"),
        ("python-2", "python", 66, 0.85, "(?:under (?:the |an )?|identifier )python(?: licen[cs]e| 2 0)(?: 2 0| version 2)?"),
        ("ruby", "ruby", 56, 0.8, "ruby licen[cs]e"),
        ("perl", "same terms as perl", 80, 0.9, "(?:under )?the same terms as perl(?: itself)?"),
        ("artistic-2", "artistic", 70, 0.9, "(?:perl )?artistic license (?:version |v ?)?2(?: 0)?"),
        ("artistic-1", "artistic", 70, 0.9, "(?:perl )?artistic license (?:version |v ?)?1(?: 0)?"),
        ("artistic-2", "artistic", 66, 0.85, "under (?:the |an )?(?:terms of the )?artistic (?:version |v ?)?2(?: 0)?"),
        ("artistic", "artistic", 54, 0.8, "(?:perl )?artistic licen[cs]e"),
        ("php-3.01", "php license", 70, 0.9, "php license (?:version |v ?)?3(?: 0| 01)"),
        ("php-3.01", "includes php software", 86, 0.9, "this product includes php software"),
        ("openssl", "openssl", 58, 0.85, "openssl licen[cs]e"),
        ("openssl", "for use in the openssl toolkit", 86, 0.9, "developed by the openssl project for use in the openssl toolkit"),
        ("openssh", "openssh", 58, 0.85, "openssh licen[cs]e"),
        ("curl", "curl", 56, 0.8, "curl licen[cs]e"),
        ("ncsa", "university of illinois", 70, 0.9, "university of illinois (?:ncsa )?open source licen[cs]e"),
        ("ncsa", "ncsa", 58, 0.85, "ncsa (?:open source )?licen[cs]e"),
        ("w3c", "w3c", 60, 0.85, "w3c (?:software (?:notice and )?|document )licen[cs]e"),
        ("icu", "icu", 56, 0.8, "icu licen[cs]e"),
        ("unicode", "unicode", 60, 0.85, "unicode (?:inc )?licen[cs]e(?: agreement)?"),
        ("ecl-2", "educational community", 70, 0.9, "educational community license (?:version |v ?)?2(?: 0)?"),
        ("upl-1", "universal permissive", 70, 0.9, "universal permissive license(?: (?:version |v ?)?1(?: 0)?)?"),
        ("beerware", "beer ware", 70, 0.9, "(?:the )?beer ware licen[cs]e"),
        ("mulan-2", "mulan", 68, 0.9, "mulan (?:psl|permissive software license)(?: (?:version |v ?)?2)?"),
        ("hpnd", "historical permission", 70, 0.9, "historical permission notice and disclaimer"),
        ("blueoak-1", "blue oak", 70, 0.9, "blue oak model license(?: 1 0 0)?"),
        ("vim", "vim", 56, 0.8, "vim licen[cs]e"),
        ("tcl", "tcl", 56, 0.8, "tcl(?: tk)? licen[cs]e"),
        ("json", "for good not evil", 86, 0.95, "the software shall be used for good not evil"),
        # fonts, data and models
        ("ofl-1.1", "open font license", 72, 0.95, "(?:sil )?open font license (?:version |v ?)?1 1"),
        ("ofl-1.1", "ofl", 66, 0.85, "(?:under (?:the |an )?|identifier |licen[cs]e )ofl (?:version |v ?)?1 1"),
        ("ofl", "open font license", 56, 0.85, "(?:sil )?open font license"),
        ("odbl-1", "open database license", 72, 0.95, "(?:odc )?open database license(?: (?:version |v ?)?1(?: 0)?)?"),
        ("odbl-1", "odbl", 66, 0.85, "(?:under (?:the |an )?|identifier |licen[cs]e )odbl(?: (?:version |v ?)?1(?: 0)?)?"),
        ("odc-by-1", "open data commons attribution", 72, 0.95, "open data commons attribution license(?: (?:version |v ?)?1(?: 0)?)?"),
        ("odc-by-1", "odc by", 66, 0.85, "odc by(?: (?:version |v ?)?1(?: 0)?)?"),
        ("pddl-1", "public domain dedication and license", 72, 0.95, "(?:odc )?public domain dedication and license(?: pddl)?"),
        ("cdla-permissive", "community data license agreement", 70, 0.9, "community data license agreement permissive(?: 1 0| 2 0)?"),
        ("cdla-sharing", "community data license agreement", 70, 0.9, "community data license agreement sharing(?: 1 0)?"),
        ("ogl", "open government", 68, 0.9, "open government licen[cs]e(?: (?:version |v ?)?[123](?: 0)?)?"),
        ("openrail", "openrail", 66, 0.9, "(?:creativeml |bigscience |bigcode )?openrail(?: m| plus plus)?(?: licen[cs]e)?"),
        ("rail", "responsible ai", 68, 0.9, "responsible ai licen[cs]es?"),
        ("llama", "llama", 66, 0.9, "llama [0-9](?: [0-9])? (?:community )?licen[cs]e(?: agreement)?"),
        ("gemma", "gemma terms of use", 66, 0.9, "gemma terms of use"),
        # source-available licenses
        ("bsl-1.1", "business source license", 72, 0.95, "business source license (?:version |v ?)?1 1"),
        ("bsl-1.1", "busl", 68, 0.9, "(?:under (?:the |an )?|identifier |licen[cs]e )?busl (?:version |v ?)?1 1"),
        ("bsl-1.1", "business source", 56, 0.8, "business source licen[cs]e"),
        ("sspl-1", "server side public license", 72, 0.95, "server side public license(?: (?:version |v ?)?1(?: 0)?)?"),
        ("sspl-1", "sspl", 66, 0.85, "(?:under (?:the |an )?|identifier |licen[cs]e )?sspl (?:version |v ?)?1(?: 0)?"),
        ("elastic-2", "elastic license", 70, 0.9, "elastic license (?:version |v ?)?2(?: 0)?"),
        ("elastic-2", "elastic&under", 66, 0.85, "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |an )?elastic(?: licen[cs]e)? (?:version |v ?)?2(?: 0)?"),
        ("elastic", "elastic", 54, 0.8, "elastic licen[cs]e"),
        ("commons-clause", "commons clause", 70, 0.9, "commons clause(?: licen[cs]e)?(?: condition)?(?: (?:version |v ?)?1 0)?"),
        ("polyform", "polyform", 68, 0.9, "polyform (?:noncommercial|small business|shield|perimeter|strict|free trial)(?: license)?(?: 1 0 0)?"),
        ("confluent", "confluent community", 66, 0.85, "confluent community licen[cs]e"),
        ("fsl", "functional source license", 68, 0.9, "functional source license(?: (?:version |v ?)?1 [01])?"),
        # Creative Commons
        ("cc0", "cc0", 62, 0.95, "cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
        ("cc0", "creative commons zero", 62, 0.95, "creative commons zero(?: licen[cs]e| 1 0| v1 0)?"),
        ("cc0", "cc zero", 60, 0.9, "cc zero"),
        ("cc0", "publicdomain zero", 76, 0.95, "creativecommons org publicdomain zero 1 0"),
        ("cc-pdm", "publicdomain mark", 76, 0.95, "creativecommons org publicdomain mark 1 0"),
        ("cc-by-1.0", "cc by 1 0", 60, 0.95, "cc by 1 0"),
        ("cc-by-2.0", "cc by 2 0", 60, 0.95, "cc by 2 0"),
        ("cc-by-2.5", "cc by 2 5", 60, 0.95, "cc by 2 5"),
        ("cc-by-3.0", "cc by 3 0", 60, 0.95, "cc by 3 0(?: us| igo| de)?"),
        ("cc-by-4.0", "cc by 4 0", 60, 0.95, "cc by 4 0(?: international)?"),
        ("cc-by-sa-1.0", "cc by sa 1 0", 60, 0.95, "cc by sa 1 0"),
        ("cc-by-sa-2.0", "cc by sa 2 0", 60, 0.95, "cc by sa 2 0"),
        ("cc-by-sa-2.5", "cc by sa 2 5", 60, 0.95, "cc by sa 2 5"),
        ("cc-by-sa-3.0", "cc by sa 3 0", 60, 0.95, "cc by sa 3 0(?: us| igo| de)?"),
        ("cc-by-sa-4.0", "cc by sa 4 0", 60, 0.95, "cc by sa 4 0(?: international)?"),
        ("cc-by-nc-2.0", "cc by nc 2 0", 60, 0.95, "cc by nc 2 0"),
        ("cc-by-nc-2.5", "cc by nc 2 5", 60, 0.95, "cc by nc 2 5"),
        ("cc-by-nc-3.0", "cc by nc 3 0", 60, 0.95, "cc by nc 3 0(?: us| igo)?"),
        ("cc-by-nc-4.0", "cc by nc 4 0", 60, 0.95, "cc by nc 4 0(?: international)?"),
        ("cc-by-nd-2.0", "cc by nd 2 0", 60, 0.95, "cc by nd 2 0"),
        ("cc-by-nd-2.5", "cc by nd 2 5", 60, 0.95, "cc by nd 2 5"),
        ("cc-by-nd-3.0", "cc by nd 3 0", 60, 0.95, "cc by nd 3 0(?: us)?"),
        ("cc-by-nd-4.0", "cc by nd 4 0", 60, 0.95, "cc by nd 4 0(?: international)?"),
        ("cc-by-nc-sa-2.0", "cc by nc sa 2 0", 60, 0.95, "cc by nc sa 2 0"),
        ("cc-by-nc-sa-2.5", "cc by nc sa 2 5", 60, 0.95, "cc by nc sa 2 5"),
        ("cc-by-nc-sa-3.0", "cc by nc sa 3 0", 60, 0.95, "cc by nc sa 3 0(?: us| igo)?"),
        ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", 60, 0.95, "cc by nc sa 4 0(?: international)?"),
        ("cc-by-nc-nd-2.0", "cc by nc nd 2 0", 60, 0.95, "cc by nc nd 2 0"),
        ("cc-by-nc-nd-2.5", "cc by nc nd 2 5", 60, 0.95, "cc by nc nd 2 5"),
        ("cc-by-nc-nd-3.0", "cc by nc nd 3 0", 60, 0.95, "cc by nc nd 3 0(?: us| igo)?"),
        ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", 60, 0.95, "cc by nc nd 4 0(?: international)?"),
        ("cc-by", "cc by", 48, 0.85, "cc by"),
        ("cc-by-sa", "cc by sa", 50, 0.9, "cc by sa"),
        ("cc-by-nd", "cc by nd", 50, 0.9, "cc by nd"),
        ("cc-by-nc-sa", "cc by nc sa", 52, 0.9, "cc by nc sa"),
        ("cc-by-nc-nd", "cc by nc nd", 52, 0.9, "cc by nc nd"),
        ("cc-by-4.0", "licenses by 4", 76, 0.95, "creativecommons org licenses by 4 0"),
        ("cc-by-3.0", "licenses by 3", 76, 0.95, "creativecommons org licenses by 3 0"),
        ("cc-by-sa-4.0", "licenses by sa 4", 76, 0.95, "creativecommons org licenses by sa 4 0"),
        ("cc-by-sa-3.0", "licenses by sa 3", 76, 0.95, "creativecommons org licenses by sa 3 0"),
        ("cc-by-nc-4.0", "licenses by nc 4", 76, 0.95, "creativecommons org licenses by nc 4 0"),
        ("cc-by-nd-4.0", "licenses by nd 4", 76, 0.95, "creativecommons org licenses by nd 4 0"),
        ("cc-by-nc-sa-4.0", "licenses by nc sa 4", 76, 0.95, "creativecommons org licenses by nc sa 4 0"),
        ("cc-by-nc-nd-4.0", "licenses by nc nd 4", 76, 0.95, "creativecommons org licenses by nc nd 4 0"),
        ("cc-by", "creative commons attribution", 50, 0.9, "creative commons attribution(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?"),
        ("cc-by-sa", "creative commons attribution", 54, 0.9, "creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?"),
        ("cc-by-nc", "creative commons attribution", 54, 0.9, "creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?"),
        ("cc-by-nd", "creative commons attribution", 54, 0.9, "creative commons attribution no ?deriv(?:s|atives)(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?"),
        ("cc-by-nc-sa", "creative commons attribution", 56, 0.9, "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?"),
        ("cc-by-nc-nd", "creative commons attribution", 56, 0.9, "creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?"),
        ("cc", "creative commons", 30, 0.6, "creative commons licen[cs]e"),
        # statements without a license's name
        ("public-domain", "public domain", 40, 0.7, "(?:in|into|to) the public domain"),
        ("public-domain", "public domain", 42, 0.8, "dedicated to the public domain"),
        ("proprietary", "proprietary and confidential", 35, 0.7, "proprietary and confidential"),
        ("proprietary", "all rights reserved", 30, 0.5, "all rights reserved"),
        ("proprietary", "unauthorized copying", 36, 0.8, "unauthorized copying of this (?:file|software|document)(?: via any medium)? is strictly prohibited"),
        ("proprietary", "trade secrets", 36, 0.7, "(?:contains|constitutes) (?:the )?trade secrets (?:of|and)"),
        ("non-commercial", "non commercial use only", 34, 0.7, "for (?:personal and )?non commercial use only"),
        ("unknown-license", "licensed under", 10, 0.3, "licensed under"),
        ("unknown-license", "licenced under", 10, 0.3, "licenced under"),
        ("unknown-license", "under&license", 10, 0.3, "under (?:the|an?) license"),
        ("unknown-license", "under&licence", 10, 0.3, "under (?:the|an?) licence"),
        ("unknown-license", "terms of", 10, 0.3, "terms of (?:the|this) licen[cs]e"),
    ]
]
