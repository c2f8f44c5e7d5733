"""Signature rules for licenses, on texts of lower-case words parted by single spaces.

A rule is a label, a keyword that its text must hold, a regular expression, a priority (0 is the strongest) and
how much a detection is worth.  Each license gives one rule per way of naming it.
"""

from __future__ import annotations

from dataclasses import dataclass

V = "(?: version| v)?"
LICENSE = "(?: public| software| documentation)? licen[cs]e"

# label, keyword, name, identifier, and where there is one: address, characteristic words of the text
LICENSES = [
    ("mit", "t", "(?:mit|expat)(?: x11)?", "mit", "opensource org licenses mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-0", "mit", "mit no attribution", "mit 0", "opensource org licenses mit 0", None),
    ("apache-2", "apache", f"apache(?: software)?(?: licen[cs]e)?{V} ?2(?: 0)?", "apache 2 0", "apache org licenses license 2 0", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-1.1", "apache", f"apache(?: software)?(?: licen[cs]e)?{V} 1 1", "apache 1 1", "apache org licenses license 1 1", None),
    ("apache-1.0", "apache", f"apache(?: software)?(?: licen[cs]e)?{V} 1 0", "apache 1 0", "apache org licenses license 1 0", None),
    ("gpl-1", "g", f"(?:gnu general public licen[cs]e|gnu gpl|gpl){V} ?1(?: 0)?", "gpl 1 0(?: only| or later)?", "gnu org licenses old licenses gpl 1 0", None),
    ("gpl-2", "g", f"(?:gnu general public licen[cs]e|gnu gpl|gpl){V} ?2(?: 0)?", "gpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 2 0", "either version 2 of the license or at your option any later version"),
    ("gpl-3", "g", f"(?:gnu general public licen[cs]e|gnu gpl|gpl){V} ?3(?: 0)?", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0", "either version 3 of the license or at your option any later version"),
    ("lgpl-2", "g", f"(?:gnu (?:library|lesser) general public licen[cs]e|gnu lgpl|lgpl){V} ?2(?: 0)?", "lgpl 2 0(?: only| or later)?", "gnu org licenses old licenses lgpl 2 0", None),
    ("lgpl-2.1", "g", f"(?:gnu lesser general public licen[cs]e|gnu lgpl|lgpl){V} ?2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 1", None),
    ("lgpl-3", "g", f"(?:gnu lesser general public licen[cs]e|gnu lgpl|lgpl){V} ?3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0", None),
    ("agpl-3", "a", f"(?:gnu affero general public licen[cs]e|gnu agpl|agpl){V} ?3(?: 0)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0", "users interacting with it remotely through a computer network"),
    ("gfdl-1.2", "g", f"(?:gnu free documentation licen[cs]e|gfdl){V} 1 2", "gfdl 1 2(?: only| or later)?", "gnu org licenses old licenses fdl 1 2", None),
    ("gfdl-1.3", "g", f"(?:gnu free documentation licen[cs]e|gfdl){V} 1 3", "gfdl 1 3(?: only| or later)?", "gnu org licenses fdl 1 3", None),
    ("bsd-0", "bsd", "(?:zero clause bsd|bsd zero clause|0 clause bsd)", "0bsd", "opensource org licenses 0bsd", None),
    ("bsd-1", "bsd", "(?:one clause bsd|bsd 1 clause|1 clause bsd)", "bsd 1 clause", None, None),
    ("bsd-2", "bsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", "bsd 2 clause", "opensource org licenses bsd 2 clause", None),
    ("bsd-3", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd 3 clause", "opensource org licenses bsd 3 clause", "neither the name of the copyright holder nor the names of its contributors"),
    ("bsd-4", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd 4 clause", None, "all advertising materials mentioning features or use of this software"),
    ("mpl-1.1", "m", f"(?:mozilla public licen[cs]e|mpl){V} 1 1", "mpl 1 1", "mozilla org mpl 1 1", None),
    ("mpl-2", "m", f"(?:mozilla public licen[cs]e|mpl){V} ?2(?: 0)?", "mpl 2 0", "mozilla org (?:en us )?mpl 2 0", "this source code form is subject to the terms of the mozilla public license"),
    ("epl-1", "e", f"(?:eclipse public licen[cs]e|epl){V} ?1(?: 0)?", "epl 1 0", "eclipse org legal epl v10", None),
    ("epl-2", "e", f"(?:eclipse public licen[cs]e|epl){V} ?2(?: 0)?", "epl 2 0", "eclipse org legal epl (?:2 0|v20)", None),
    ("edl-1", "eclipse", f"eclipse distribution licen[cs]e{V} ?1(?: 0)?", "edl 1 0", "eclipse org org documents edl v10", None),
    ("cddl-1", "cddl", f"(?:common development and distribution licen[cs]e )?cddl{V} ?1(?: 0)?", "cddl 1 0", "opensource org licenses cddl 1 0", None),
    ("cddl-1.1", "cddl", f"(?:common development and distribution licen[cs]e )?cddl{V} 1 1", "cddl 1 1", None, None),
    ("cpl-1", "common", f"common public licen[cs]e{V} ?1(?: 0)?", "cpl 1 0", "opensource org licenses cpl1 0", None),
    ("isc", "isc", "isc", "isc", "opensource org licenses isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib", "opensource org licenses zlib", "this software is provided as is without any express or implied warranty in no event"),
    ("libpng", "libpng", "libpng", "libpng(?: 2 0)?", None, None),
    ("boost-1", "boost", f"boost(?: software)?(?: licen[cs]e)?{V} ?1(?: 0)?", "bsl 1 0", "boost org license 1 0", None),
    ("busl-1.1", "business", f"business source licen[cs]e{V} 1 1", "busl 1 1", "mariadb com bsl11", None),
    ("unlicense", "unlicense", "unlicense", "unlicense", "unlicense org", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl", "wtfpl net", None),
    ("artistic-1", "artistic", f"artistic licen[cs]e{V} ?1(?: 0)?", "artistic 1 0", "opensource org licenses artistic license 1 0", None),
    ("artistic-2", "artistic", f"artistic licen[cs]e{V} ?2(?: 0)?", "artistic 2 0", "opensource org licenses artistic license 2 0", None),
    ("cc0-1", "c", "(?:cc0|cc zero|creative commons zero)", "cc0 1 0", "creativecommons org publicdomain zero", None),
    ("cc-by", "c", "(?:cc by|creative commons attribution)", "cc by [1-4] [05]", "creativecommons org licenses by [1-4] [05]", None),
    ("cc-by-sa", "c", "(?:cc by sa|creative commons attribution share ?alike)", "cc by sa [1-4] [05]", "creativecommons org licenses by sa", None),
    ("cc-by-nd", "c", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)", "cc by nd [1-4] [05]", "creativecommons org licenses by nd", None),
    ("cc-by-nc", "c", "(?:cc by nc|creative commons attribution non ?commercial)", "cc by nc [1-4] [05]", "creativecommons org licenses by nc", None),
    ("cc-by-nc-sa", "c", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "cc by nc sa [1-4] [05]", "creativecommons org licenses by nc sa", None),
    ("cc-by-nc-nd", "c", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)", "cc by nc nd [1-4] [05]", "creativecommons org licenses by nc nd", None),
    ("odbl-1", "o", f"(?:open database licen[cs]e|odbl){V} ?1?(?: 0)?", "odbl 1 0", "opendatacommons org licenses odbl", None),
    ("odc-by-1", "o", f"(?:open data commons attribution licen[cs]e|odc by){V} ?1?(?: 0)?", "odc by 1 0", "opendatacommons org licenses by", None),
    ("pddl-1", "p", f"(?:public domain dedication and licen[cs]e|pddl){V} ?1?(?: 0)?", "pddl 1 0", "opendatacommons org licenses pddl", None),
    ("ofl-1.1", "o", f"(?:sil open font licen[cs]e|open font licen[cs]e|ofl){V} 1 1", "ofl 1 1", "scripts sil org ofl", None),
    ("psf-2", "p", f"(?:python software foundation licen[cs]e|psf licen[cs]e){V} ?2?(?: 0)?", "(?:psf|python) 2 0(?: 1)?", "python org psf license", None),
    ("php-3", "php", f"php licen[cs]e{V} 3(?: 0)?", "php 3 0", "php net license 3 0", None),
    ("php-3.01", "php", f"php licen[cs]e{V} 3 01", "php 3 01", "php net license 3 01", None),
    ("ruby", "ruby", "ruby", "ruby", "ruby lang org en about license", None),
    ("ms-pl", "m", "(?:microsoft public|ms pl)", "ms pl", "opensource org licenses ms pl", None),
    ("ms-rl", "m", "(?:microsoft reciprocal|ms rl)", "ms rl", "opensource org licenses ms rl", None),
    ("eupl-1.1", "e", f"(?:european union public licen[cs]e|eupl){V} 1 1", "eupl 1 1", None, None),
    ("eupl-1.2", "e", f"(?:european union public licen[cs]e|eupl){V} 1 2", "eupl 1 2", "joinup ec europa eu collection eupl", None),
    ("osl-3", "o", f"(?:open software licen[cs]e|osl){V} ?3(?: 0)?", "osl 3 0", "opensource org licenses osl 3 0", None),
    ("afl-3", "a", f"(?:academic free licen[cs]e|afl){V} ?3(?: 0)?", "afl 3 0", "opensource org licenses afl 3 0", None),
    ("w3c", "w3c", "w3c(?: software(?: notice)?)?", "w3c", "w3 org consortium legal", None),
    ("x11", "x11", "x11", "x11", None, None),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa", "opensource org licenses ncsa", None),
    ("postgresql", "postgresql", "postgresql", "postgresql", "opensource org licenses postgresql", None),
    ("openssl", "openssl", "openssl", "openssl", "openssl org source license", None),
    ("sleepycat", "sleepycat", "sleepycat", "sleepycat", None, None),
    ("vim", "vim", "vim", "vim", None, None),
    ("beerware", "beerware", "beerware", "beerware", None, "you can buy me a beer in return"),
    ("json", "json", "json", "json", "json org license", "the software shall be used for good not evil"),
    ("upl-1", "universal", f"universal permissive licen[cs]e{V} ?1?(?: 0)?", "upl 1 0", "opensource org licenses upl", None),
    ("sspl-1", "s", f"(?:server side public licen[cs]e|sspl){V} ?1?(?: 0)?", "sspl 1 0", "mongodb com licensing server side public license", None),
    ("elastic-2", "elastic", f"elastic licen[cs]e{V} ?2(?: 0)?", "elastic 2 0", "elastic co licensing elastic license", None),
    ("mulan-2", "mulan", f"mulan (?:permissive software licen[cs]e|psl){V} ?2", "mulanpsl 2 0", "license coscl org cn mulanpsl2", None),
    ("blueoak-1", "blue", "blue oak model", "blueoak 1 0 0", "blueoakcouncil org license 1 0 0", None),
    ("public-domain", "public", "public domain", "licenseref public domain", "creativecommons org publicdomain mark", "(?:dedicated|released|placed) (?:in|to|into) the public domain"),
    ("proprietary", "r", "(?:proprietary|commercial)", "licenseref proprietary", None, "all rights reserved"),
]

# words -> label: the phrases whose places are reported as they stand
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# What a grant begins with.
VERBS = ("licensed", "released", "distributed", "available", "provided", "published", "used", "covered")
BY = ("under", "by")

# One of these stands in every text that any rule finds: a grant may name a license without that word,
# so what it begins with is among them.
GATES = (
    "licen", "spdx", "cc by", "cc0", "publicdomain", "public domain", "unlicense", "creativecommons",
    "permission", "rights reserved", "free and unencumbered", "buy me a beer", "used for good", "wtfpl", "gpl",
    "without any express", "remotely through", "the names of its", "advertising materials", "mariadb com bsl11", "bsl 1 0",
    "opensource org", "eclipse org", "mozilla org", "boost org", "python org psf", "scripts sil org", "joinup ec",
    "w3 org consortium", "mongodb com", "odbl", "pddl",
    *(f"{verb} {by}" for verb in VERBS if "licen" not in verb for by in BY),
)


@dataclass(frozen=True)
class LicenseRule:
    label: str
    keyword: str
    pattern: str
    priority: int
    worth: float
    phrase: bool = False


def rules(phrases: dict[str, str] = PHRASES) -> list[LicenseRule]:
    """All rules in order: of equal priority and place, the earlier one counts."""
    found = [LicenseRule(label, words, words, 1, 0.95, True) for words, label in phrases.items()]
    granted = f"(?:{'|'.join(VERBS)}) (?:{'|'.join(BY)}) (?:the )?(?:terms of )?(?:the )?"
    for label, keyword, name, identifier, address, text in LICENSES:
        found.append(LicenseRule(label, "spdx", f"spdx license identifier {identifier}", 0, 1.0))
        found.append(LicenseRule(label, keyword, f"{granted}{name}(?:{LICENSE})?", 1, 0.95))
        if address:
            found.append(LicenseRule(label, address.split()[0], f"(?:www )?{address}", 2, 0.9))
        if text:
            start = text.split()[0]
            found.append(LicenseRule(label, start if start.isalnum() else "public domain", text, 2, 0.85))
        found.append(LicenseRule(label, keyword, f"{name}{LICENSE}", 3, 0.7))
        found.append(LicenseRule(label, "licen", f"licen[cs]ed? (?:{V.strip()} )?{identifier}", 3, 0.6))
    return found
