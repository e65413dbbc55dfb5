"""Patterns of personal data with a form of their own. Each is valid for Java and Python expressions alike."""

AT = r"(?:\s?[\[(]\s?at\s?[\])]\s?|@)"
DOT = r"(?:\s?[\[(]\s?dot\s?[\])]\s?|\.)"
EMAIL = rf"(?i:(?<![a-z0-9._%+\-])[a-z0-9][a-z0-9._%+\-]*{AT}[a-z0-9\-]+(?:{DOT}[a-z0-9\-]+)*{DOT}[a-z]{{2,}}(?![a-z0-9]))"

_EXT = r"(?:,?\s?(?:x|ext\.?|extension|Durchwahl|poste)\s?[0-9]{1,5})?"
_END = r"(?![0-9A-Za-z]|[.\-/][0-9])"
_START = r"(?<![0-9A-Za-z#]|[0-9][.\-/]|[0-9] )"
PHONE = (
    rf"{_START}(?:"
    # international, grouped at will
    r"\+[1-9][0-9]{0,2}(?:[ .\-]?\(0?[0-9]{0,4}\))?(?:[ .\-/]?[0-9]{1,11}){2,7}"
    r"|(?![0-9]{4}[ .\-][0-9]{4}[ .\-][0-9]{4}(?![0-9]))00[1-9][0-9]{1,2}[ .\-]?(?:\(0\)[ ]?)?[1-9][0-9]{1,4}(?:[ .\-]?[0-9]{2,5}){2,4}"
    # North American
    r"|(?:1[ .\-])?(?:\([2-9][0-9]{2}\)[ ]?|[2-9][0-9]{2}[ .\-])[0-9]{3}[ .\-][0-9]{4}"
    # national with a trunk zero
    r"|\(0[1-9][0-9]{0,3}\)[ ]?[0-9]{3,4}[ \-]?[0-9]{3,4}"
    r"|0[1-9](?:[ .\-][0-9]{2}){4}"
    r"|0[1-9][0-9][ \-][0-9]{4}[ \-][0-9]{4}"
    r"|0[1-9][0-9]{2}[ \-][0-9]{3}[ \-][0-9]{4}"
    r"|07[0-9]{3}[ \-][0-9]{3}[ \-]?[0-9]{3}"
    r"|0[1-9][0-9]{1,4}/[0-9]{5,9}(?:-[0-9]{1,4})?"
    rf"){_EXT}{_END}"
)

_ISOLATED = r"(?<![0-9A-Za-z]|[0-9A-Za-z][\-.])"
_CLOSED = r"(?![0-9A-Za-z]|-[0-9A-Za-z])"
ID = (
    rf"{_ISOLATED}(?:"
    # resident register: four, four, four (and no fourth group on either side)
    r"(?<![0-9] )[0-9]{4}([ \-.])[0-9]{4}\1[0-9]{4}(?![ \-.][0-9])"
    # social security
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}"
    # tax card, insurance number, national identity, identity card, passport
    r"|[A-Z]{5}[0-9]{4}[A-Z]"
    r"|[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]"
    r"|[0-9]{8}-?[A-Z]"
    r"|[A-Z]{2}[0-9]{2}[A-Z][0-9]{3}"
    r"|[A-Z][0-9]{7}"
    rf"){_CLOSED}"
)

_CAP = r"\p{Lu}[\p{L}'’\-]+"
ADDRESS = (
    r"(?:(?<![0-9\p{L}.,])[0-9]{1,5}[a-zA-Z]?,?\s"
    rf"(?:{_CAP}\s){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Close|Terrace|Place|Pl|Square|Sq|Way|Boulevard|Blvd|Crescent|Gardens|Row|Walk|Grove|Mews|STREET|ST|ROAD|RD|AVENUE|AVE|LANE|DRIVE|COURT|CLOSE|TERRACE)(?![\p{{L}}])"
    r"|(?<![0-9\p{L}.,])[0-9]{1,4}(?:\s?(?:bis|ter))?,?\s(?i:rue|avenue|boulevard|impasse|place|allée|chemin|quai|cours|route|square|passage)\s(?i:de la |de l['’]|des |du |de |d['’]|la |le |les )*"
    rf"{_CAP}"
    rf"|(?i:calle|avenida|avda\.|paseo|plaza|camino|carrera|ronda|travesía|carretera)\s(?i:del |de |la |las |los |el )*{_CAP}(?:\s{_CAP})*,?\s(?:n\.?[º°]?\s?)?[0-9]{{1,4}}(?![0-9])"
    r"|\p{Lu}[\p{L}\-]*(?:straße|strasse|str\.|weg|allee|platz|gasse|ufer|damm|STRASSE|WEG|ALLEE|PLATZ)\s[0-9]{1,4}(?:\s?[a-z])?(?![0-9\p{L}])"
    rf"|(?:Am|An der|An den|Im|In der|Auf der|Auf dem|Zum|Zur|Obere|Untere|Alte|Neue|Lange|Kurze|Große|Kleine)\s{_CAP}\s[0-9]{{1,3}}(?:\s?[a-z])?(?![0-9\p{{L}}%])"
    r")"
)

HONORIFIC = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Mlle|Sr|Sra|Señora?|Don|Doña|MR|MRS|MS|DR|PROF)"
_WORD = r"\p{Lu}[\p{L}’']+(?:-\p{Lu}[\p{L}’']+)*"
_PARTICLE = r"(?:(?:van|von|de|del|della|di|da|dos|la|le|el|al|bin|ter|ten|zu|VAN|VON|DE)\s){0,2}"
#: A title is evidence enough; initials may stand between.
TITLED = rf"(?<!\p{{L}}){HONORIFIC}\.?\s(?:\p{{Lu}}\.\s?){{0,3}}(?:{_WORD}\s(?:\p{{Lu}}\.\s)?){{0,1}}{_PARTICLE}{_WORD}"
#: Given name first (group 2) or last (group 3), the whole in group 1; matches overlap, so that every word is asked.
DIRECT = rf"(?<![\p{{L}}.@\-])(?=(({_WORD})\s(?:\p{{Lu}}\.\s?){{0,2}}{_PARTICLE}({_WORD})))"
INVERTED = rf"(?<![\p{{L}}.@\-])(?=(({_WORD}),\s({_WORD})))"
#: Street words that stand before the name of the street.
STREET_FIRST = r"rue|avenue|boulevard|impasse|place|allée|chemin|quai|cours|route|square|passage|calle|avenida|avda\.|paseo|plaza|camino|carrera|ronda|travesía|carretera|am|an|im|in|auf|zum|zur|obere|untere|alte|neue|lange|kurze|große|kleine"
