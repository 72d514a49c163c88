"""Signature rules of the license scan, matched on words joined by one space.

A pattern sees ASCII lower-case words (a non-ASCII character shows as ``_``).
``keyword`` is a word that every match of the pattern holds: a text without it
is not tried. Families with versions are written as one rule each and expanded.
"""

from __future__ import annotations

from dataclasses import dataclass

# Priorities: a full name with version beats a name, a name beats a hint.
EXACT, NAME, TEXT, HINT = 100, 80, 60, 30
LEVELS = (HINT, TEXT, NAME, EXACT)


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    priority: int
    pattern: str


# Phrases of the base labels.
BASE = (("cc-by", ("cc", "by")), ("gpl", ("general", "public", "license")), ("reserved", ("all", "rights", "reserved")))

# Names and wordings, as label, keyword, priority, pattern.
HAND = (
    ("mit", "mit", NAME, r"mit licen[sc]ed?"),
    ("mit", "mit", NAME, r"licensed under (the )?(terms of the )?mit"),
    ("mit", "mit", EXACT, r"spdx license identifier mit"),
    ("mit", "charge", TEXT, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", TEXT, r"use copy modify merge publish distribute sublicense and or sell"),
    ("mit-0", "mit", EXACT, r"mit (0|no attribution)( licen[sc]e)?"),
    ("x11", "x11", NAME, r"x11 licen[sc]e"),
    ("isc", "isc", NAME, r"isc licen[sc]e"),
    ("isc", "purpose", TEXT, r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "bsd", HINT, r"bsd (style )?licen[sc]ed?"),
    ("bsd-1-clause", "bsd", NAME, r"(1|one) clause bsd|bsd (1|one) clause"),
    ("bsd-2-clause", "bsd", NAME, r"(2|two) clause bsd|bsd (2|two) clause|simplified bsd"),
    ("bsd-2-clause", "freebsd", NAME, r"freebsd licen[sc]e"),
    ("bsd-3-clause", "bsd", NAME, r"(3|three) clause bsd|bsd (3|three) clause|(new|revised|modified) bsd"),
    ("bsd-4-clause", "bsd", NAME, r"(4|four) clause bsd|bsd (4|four) clause|original bsd"),
    ("0bsd", "0bsd", NAME, r"0bsd( licen[sc]e)?"),
    ("bsd", "redistribution", TEXT, r"redistribution and use in source and binary forms( with or without modification)?"),
    ("bsd-3-clause", "endorse", TEXT, r"(used )?to endorse or promote products derived from"),
    ("apache", "apache", HINT, r"apache (software )?licen[sc]ed?"),
    ("apache-2.0", "apache", EXACT, r"licensed under the apache license version 2 0"),
    ("apache-2.0", "apache", EXACT, r"apache org licenses license 2 0"),
    ("gpl", "gpl", NAME, r"gnu gpl|gpl licen[sc]ed?"),
    ("gpl", "gnu", NAME, r"gnu general public licen[sc]e"),
    ("gpl", "gplv2", EXACT, r"gplv2( only)?"),
    ("gpl-2.0-or-later", "gplv2", EXACT, r"gplv2 or later"),
    ("gpl", "gplv3", EXACT, r"gplv3( only)?"),
    ("gpl-3.0-or-later", "gplv3", EXACT, r"gplv3 or later"),
    ("lgpl", "lgpl", NAME, r"(gnu )?lgpl"),
    ("lgpl", "lesser", NAME, r"(gnu )?lesser general public licen[sc]e"),
    ("lgpl", "library", NAME, r"gnu library general public licen[sc]e"),
    ("lgpl", "lgplv3", EXACT, r"lgplv3( or later)?"),
    ("agpl", "agpl", NAME, r"(gnu )?agpl"),
    ("agpl", "affero", NAME, r"(gnu )?affero general public licen[sc]e"),
    ("agpl", "agplv3", EXACT, r"agplv3( or later)?"),
    ("gfdl", "gfdl", NAME, r"(gnu )?gfdl"),
    ("gfdl", "documentation", NAME, r"(gnu )?free documentation licen[sc]e"),
    ("gpl", "redistribute", TEXT, r"free software you can redistribute it and or modify it under the terms of"),
    ("gpl-exception", "linking", TEXT, r"(special|linking) exception (to|for) linking"),
    ("classpath-exception", "classpath", NAME, r"classpath exception"),
    ("mpl", "mozilla", NAME, r"mozilla public licen[sc]e"),
    ("mpl", "mpl", HINT, r"mpl licen[sc]ed?"),
    ("epl", "eclipse", NAME, r"eclipse public licen[sc]e"),
    ("edl", "eclipse", NAME, r"eclipse distribution licen[sc]e"),
    ("cddl", "cddl", NAME, r"cddl( licen[sc]e)?"),
    ("cddl", "distribution", NAME, r"common development and distribution licen[sc]e"),
    ("cpl", "common", NAME, r"common public licen[sc]e"),
    ("cpal", "attribution", NAME, r"common public attribution licen[sc]e"),
    ("ipl", "ibm", NAME, r"ibm public licen[sc]e"),
    ("eupl", "eupl", NAME, r"eupl( licen[sc]e)?"),
    ("eupl", "european", NAME, r"european union public licen[sc]e"),
    ("osl", "open", NAME, r"open software licen[sc]e"),
    ("afl", "academic", NAME, r"academic free licen[sc]e"),
    ("artistic", "artistic", NAME, r"(perl )?artistic licen[sc]e"),
    ("bsl", "boost", NAME, r"boost software licen[sc]e"),
    ("busl", "business", NAME, r"business source licen[sc]e"),
    ("sspl", "sspl", NAME, r"sspl( licen[sc]e)?"),
    ("sspl", "server", NAME, r"server side public licen[sc]e"),
    ("elastic", "elastic", NAME, r"elastic licen[sc]e"),
    ("commons-clause", "commons", NAME, r"commons clause( license condition)?"),
    ("zlib", "zlib", NAME, r"zlib( libpng)? licen[sc]e"),
    ("zlib", "misrepresented", TEXT, r"the origin of this software must not be misrepresented"),
    ("libpng", "libpng", NAME, r"libpng licen[sc]e"),
    ("png", "png", NAME, r"png reference library licen[sc]e"),
    ("openssl", "openssl", NAME, r"openssl licen[sc]e"),
    ("curl", "curl", NAME, r"curl licen[sc]e"),
    ("php", "php", NAME, r"php licen[sc]e"),
    ("python", "python", NAME, r"python (software foundation )?licen[sc]e"),
    ("psf", "psf", NAME, r"psf licen[sc]e"),
    ("ruby", "ruby", NAME, r"ruby licen[sc]e"),
    ("postgresql", "postgresql", NAME, r"postgresql licen[sc]e"),
    ("ncsa", "ncsa", NAME, r"(university of illinois )?ncsa (open source )?licen[sc]e"),
    ("w3c", "w3c", NAME, r"w3c (software|document) (notice and )?licen[sc]e"),
    ("wtfpl", "wtfpl", NAME, r"wtfpl"),
    ("unlicense", "unlicense", NAME, r"(the )?unlicense"),
    ("unlicense", "unencumbered", TEXT, r"free and unencumbered software released into the public domain"),
    ("public-domain", "domain", NAME, r"public domain( dedication)?"),
    ("public-domain", "domain", TEXT, r"(released|dedicated|placed) (in|into|to) the public domain"),
    ("cc0-1.0", "cc0", EXACT, r"(creative commons )?cc0( 1 0)?( universal)?"),
    ("cc0-1.0", "zero", NAME, r"creative commons zero( v?1 0)?"),
    ("cc", "creative", HINT, r"creative commons( licen[sc]ed?)?"),
    ("cc-pdm", "mark", NAME, r"public domain mark( 1 0)?"),
    ("pddl", "pddl", NAME, r"pddl"),
    ("odbl", "odbl", NAME, r"odbl"),
    ("odbl", "database", NAME, r"open database licen[sc]e"),
    ("odc-by", "commons", NAME, r"open data commons attribution licen[sc]e"),
    ("ogl-uk", "government", NAME, r"open government licen[sc]e"),
    ("cdla", "cdla", NAME, r"cdla (permissive|sharing)( [12] 0)?"),
    ("ofl", "ofl", NAME, r"(sil )?ofl"),
    ("ofl", "font", NAME, r"(sil )?open font licen[sc]e"),
    ("beerware", "beerware", NAME, r"beerware( licen[sc]e)?"),
    ("json", "evil", TEXT, r"shall be used for good not evil"),
    ("ms-pl", "microsoft", NAME, r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", NAME, r"microsoft reciprocal licen[sc]e"),
    ("ms-eula", "microsoft", NAME, r"microsoft software licen[sc]e terms"),
    ("apsl", "apple", NAME, r"apple public source licen[sc]e"),
    ("npl", "netscape", NAME, r"netscape public licen[sc]e"),
    ("qpl", "q", NAME, r"q public licen[sc]e"),
    ("sleepycat", "sleepycat", NAME, r"sleepycat licen[sc]e"),
    ("upl", "universal", NAME, r"universal permissive licen[sc]e"),
    ("vim", "vim", NAME, r"vim licen[sc]e"),
    ("openrail", "openrail", NAME, r"(bigscience |creativeml )?openrail( m)?( licen[sc]e)?"),
    ("llama", "llama", NAME, r"llama [234]( [0-9])? community licen[sc]e( agreement)?"),
    ("gemma", "gemma", NAME, r"gemma terms of use"),
    ("proprietary", "proprietary", HINT, r"proprietary (and confidential|software|licen[sc]e)"),
    ("proprietary", "prohibited", TEXT, r"(unauthorized|unauthorised) (copying|reproduction|use|distribution)( of this (file|work))?( via any medium)? is( strictly)? prohibited"),
    ("proprietary", "eula", HINT, r"eula"),
    ("proprietary", "agreement", HINT, r"end user licen[sc]e agreement"),
    ("non-commercial", "commercial", HINT, r"(for )?non commercial use only|not for commercial use"),
    ("non-commercial", "noncommercial", HINT, r"noncommercial use only"),
    ("research-only", "research", HINT, r"(for )?research (use|purposes) only"),
    ("no-derivatives", "derivative", HINT, r"no derivative works"),
    ("copyright", "copyright", HINT, r"copyright (c )?(19|20)[0-9][0-9]( (19|20)[0-9][0-9])?"),
    ("copyright", "copyrighted", HINT, r"copyrighted material"),
    ("reserved", "reserved", HINT, r"(some|no) rights reserved"),
    ("warranty-disclaimer", "warranty", HINT, r"without warranty of any kind|without any warranty"),
    ("as-is", "provided", HINT, r"software is provided as is"),
    ("patent-grant", "patent", HINT, r"(additional )?grant of patent rights|patent licen[sc]e"),
)

# Families as label, keyword, name pattern, versions.
FAMILIES = (
    ("apache", "apache", r"apache (software )?licen[sc]e( version| v)?", "1.0 1.1 2.0"),
    ("apache", "apache", r"apache( v)?", "1.0 1.1 2.0"),
    ("gpl", "gnu", r"gnu general public licen[sc]e( version| v)?", "1.0 2.0 3.0 1 2 3"),
    ("gpl", "gpl", r"(gnu )?gpl( version| v)?", "1.0 2.0 3.0 1 2 3"),
    ("lgpl", "lesser", r"(gnu )?lesser general public licen[sc]e( version| v)?", "2.1 3.0 3"),
    ("lgpl", "lgpl", r"(gnu )?lgpl( version| v)?", "2.0 2.1 3.0 2 3"),
    ("agpl", "affero", r"(gnu )?affero general public licen[sc]e( version| v)?", "1.0 3.0 1 3"),
    ("agpl", "agpl", r"(gnu )?agpl( version| v)?", "1.0 3.0 3"),
    ("gfdl", "gfdl", r"(gnu )?gfdl( version| v)?", "1.1 1.2 1.3"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e( version| v)?", "1.0 1.1 2.0"),
    ("mpl", "mpl", r"mpl( version| v)?", "1.0 1.1 2.0"),
    ("epl", "eclipse", r"eclipse public licen[sc]e( version| v)?", "1.0 2.0"),
    ("cddl", "cddl", r"cddl( version| v)?", "1.0 1.1"),
    ("eupl", "eupl", r"eupl( version| v)?", "1.0 1.1 1.2"),
    ("osl", "osl", r"osl( version| v)?", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", "afl", r"afl( version| v)?", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic", r"artistic licen[sc]e( version| v)?", "1.0 2.0"),
    ("bsl", "boost", r"boost software licen[sc]e( version| v)?", "1.0"),
    ("busl", "business", r"business source licen[sc]e( version| v)?", "1.0 1.1"),
    ("python", "python", r"python licen[sc]e( version| v)?", "2.0"),
    ("ofl", "ofl", r"(sil )?ofl( version| v)?", "1.0 1.1"),
    ("ogl-uk", "ogl", r"ogl( version| v)?", "1.0 2.0 3.0"),
    ("cc-by", "cc", r"cc by( licen[sc]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "cc", r"cc by sa( licen[sc]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "cc", r"cc by nd( licen[sc]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "cc", r"cc by nc( licen[sc]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa( licen[sc]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd( licen[sc]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", "creative", r"creative commons attribution( licen[sc]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike( licen[sc]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(ative)?s( licen[sc]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial( licen[sc]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike( licen[sc]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(ative)?s( licen[sc]e)?", "1.0 2.0 2.5 3.0 4.0"),
)


def signatures() -> list[Signature]:
    """All rules: as written, then each family without and with its versions."""
    rules = [Signature(*r) for r in HAND]
    for label, keyword, name, versions in FAMILIES:
        if label.startswith("cc-"):
            rules.append(Signature(label, keyword, NAME, name))
        for v in versions.split():
            full = f"{label}-{v if '.' in v else v + '.0'}"
            rules.append(Signature(full, keyword, EXACT, f"{name} {v.replace('.', ' ')}( international| unported)?"))
            if label in ("gpl", "lgpl", "agpl"):
                rules.append(Signature(f"{full}-or-later", keyword, EXACT, f"{name} {v.replace('.', ' ')}( or)?( any)? (later|newer)( version)?"))
    return rules
