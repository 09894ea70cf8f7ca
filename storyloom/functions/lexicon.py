"""Cue vocabularies of the two languages, as word lists, and the patterns made of them.

A pattern comes in two dialects: ``java`` for Spark and ``re2`` for engines whose classes are ASCII. Entries may hold classes such as
``\\w+``; an entry that is listed earlier wins where two begin at one place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

# Vocabularies.

EN: dict[str, list[str]] = {
    "conjunction": ["and then", "and", "but", "or", "yet", "so", "when", "while", "because", "then"],
    "verb": [
        "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "shall", "would", "could", "might", "must", "can",
        "grew", "grow", "grows", "growing", "came", "come", "go", "went", "walks?", "walked", "walking", "travels?", "traveled", "travelled", "traveling",
        "searches?", "searched", "searching", "finds?", "found", "finding", "remembers?", "remembered", "remembering", "recalls?", "recalled", "recalling",
        "lives?", "lived", "living", "opens?", "opened", "opening", "disappears?", "disappeared", "disappearing", "left", "leave", "leaves", "leaving",
        "met", "meet", "meets", "meeting", "looks?", "looked", "looking", "waits?", "waited", "waiting", "carried", "carry", "carries", "carrying",
        "jumps?", "jumped", "jumping", "climbs?", "climbed", "climbing", "follows?", "followed", "following", "think", "thinks", "thought",
        "saw", "see", "sees", "seeing", "entered", "enter", "enters", "entering", r"\w+(?:ed|ing)",
    ],
    "future": ["will", "shall", "would", "might", "could", "going to", "tomorrow", "later", "soon", "future"],
    "past": [
        "had", "was", "were", "did", "grew", "found", "saw", "came", "went", "left", "met", "thought", "remembered", "recalled", "dreamed",
        "years earlier", "earlier", "long ago", "back then", "ago", "yesterday", r"last\s+\w+", r"before\b", r"\w+ed",
    ],
    "anchor": [
        "now", "today", "yesterday", "tomorrow", "earlier", "years earlier", r"last\s+\w+", r"next\s+\w+", r"before\s+(?:the\s+)?\w+", r"after\s+(?:the\s+)?\w+",
        r"\d+\s+(?:year|years|month|months|week|weeks|day|days|hour|hours)\s+(?:old|ago)", r"\d{4}", "Christmas", "Thanksgiving",
    ],
    "place_preposition": ["in", "at", "on", "to", "from", "inside", "outside", "near"],
    "temporal_entity": [
        "Now", "Last", "Tomorrow", "Today", "Yesterday", "Christmas", "Thanksgiving", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
        "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
    ],
    "remember": ["remembered", "recalled", "dreamed", "years earlier", "long ago", "back then", "childhood", "past"],
    "perception": ["saw", "seen", "heard", "felt", "noticed", "watched", "observed"],
    "reporting": ["said", "told", "asked", "answered", "reported", "announced", "wrote", "explained"],
    "intention": ["tried", "attempted", "decided", "planned", "promised", "agreed", "refused", "started", "began"],
    "cognition": ["thought", "believed", "knew", "wanted", "imagined", "hoped", "feared", "wondered", "supposed"],
    "state": ["am", "is", "are", "was", "were", "be", "been", "being", "lives?", "lived", "knows?", "knew", "has", "had"],
    "supposition": ["might", "perhaps", "supposed", "imagined", "could have", "would have", "if only"],
    "general": ["always", "never", "generally", "usually", "everyone knows"],
    "fiction": ["in the story", "in the play", "in the film", "fictional", "invented"],
    "join": ["met", "found", "joined", "reunited", "came together", "encountered"],
    "split": ["left", "departed", "separated", "split", "alone", "disappeared", "lost"],
    "parallel": ["meanwhile", "elsewhere", "at the same time", "simultaneously", "in another"],
    "retrospective": ["years earlier", "earlier", "long ago", "back then", "previously", "formerly", r"had\s+(?:been\s+)?\w+(?:ed|en)?"],
    "sequential": ["and then", "then", "subsequently", "next"],
    "forward": ["later", "afterward", "afterwards", "eventually", "finally", r"after\s+(?:the\s+)?\w+"],
    "perfective": [r"(?:had|has|have)\s+(?:been\s+)?\w+(?:ed|en)"],
    "progressive": [r"(?:am|is|are|was|were|be|been|being)\s+\w+ing"],
    "negative": ["not", "never", "no", "n't"],
    "duration": [r"(?:for\s+)?\d+\s+(?:second|seconds|minute|minutes|hour|hours|day|days|week|weeks|month|months|year|years)"],
    "clock": ["dawn", "noon", "midnight", "night", "morning", "evening", r"\d{1,2}:\d{2}"],
    "recurring": ["always", "usually", "often", r"every\s+\w+"],
}

RO: dict[str, list[str]] = {
    "conjunction": ["și apoi", "si apoi", "și", "si", "dar", "însă", "insa", "apoi", "atunci", "când", "cand", "în timp ce", "in timp ce", "pentru că", "pentru ca", "deoarece"],
    "verb": [
        "este", "sunt", "era", "erau", "fost", "fi", "are", "avea", "aveau", "avut", "va", "vor", "voi", "vei", "vom", "veți", "veti", "merge", "mergea", "mers", "mersese",
        "pleacă", "pleaca", "plecat", "plecase", "caută", "cauta", "căuta", "căutat", "cautat", "găsește", "gaseste", "găsit", "gasit",
        "își amintește", "isi aminteste", "își amintea", "isi amintea", "amintit", "trăiește", "traieste", "locuiește", "locuieste", "locuia",
        "dispărut", "disparut", "dispare", "spune", "spus", "vede", "văzut", "vazut", "aude", "auzit", "întâlnește", "intalneste", "întâlnit", "intalnit",
        "așteaptă", "asteapta", "așteptat", "asteptat", "călătorește", "calatoreste", "călătorit", "calatorit", "duce", "dus", "intră", "intra", "intrat",
        "deschide", "deschis", "urcă", "urca", "urcat", "urmează", "urmeaza", "urmărit", "urmarit", "crește", "creste", "crescut",
        "gândește", "gandeste", "gândit", "gandit", "crede", "crezut", r"\w+(?:at|it|ut|ase|ese|ise|use|ează|eaza|esc|ește|ind|ând|and)",
    ],
    "future": ["va", "vor", "voi", "vei", "vom", "veți", "veti", r"o\s+să", r"o\s+sa", "mâine", "maine", r"mai\s+târziu", r"mai\s+tarziu", "viitor", r"urmează\s+să", r"urmeaza\s+sa"],
    "past": [
        "era", "erau", "fusese", "fuseseră", "fusesera", "plecase", "mersese", "găsit", "gasit", "văzut", "vazut", "spus", "amintit", "căutat", "cautat", "crescut", "dus",
        "ieri", "odinioară", "odinioara", "demult", "înainte", "inainte", r"cu\s+(?:\d+\s+\w+|ani|mult\s+timp)\s+(?:în\s+urmă|in\s+urma)", r"\w+(?:ase|ese|ise|use|at|it|ut)",
    ],
    "anchor": [
        "acum", "astăzi", "astazi", "azi", "ieri", "mâine", "maine", r"mai\s+devreme", r"mai\s+târziu", r"mai\s+tarziu", "odinioară", "odinioara", "demult", "cândva", "candva",
        r"înainte(?:\s+de\s+\w+)?", r"inainte(?:\s+de\s+\w+)?", r"după(?:\s+de\s+\w+|\s+\w+)?", r"dupa(?:\s+de\s+\w+|\s+\w+)?",
        r"cu\s+(?:\d+\s+(?:ani|luni|zile|ore)|ani|mult\s+timp)\s+(?:în\s+urmă|in\s+urma)", r"\d{4}", "Crăciun", "Craciun", "Paște", "Paste", "Paști", "Pasti",
    ],
    "place_preposition": ["în", "in", "la", "spre", "din", "lângă", "langa", r"aproape\s+de", "către", "catre"],
    "place_article": ["un", "o", "același", "acelasi", "aceeași", "aceeasi"],
    "temporal_entity": [
        "Acum", "Astăzi", "Astazi", "Azi", "Ieri", "Mâine", "Maine", "Luni", "Marți", "Marti", "Miercuri", "Joi", "Vineri", "Sâmbătă", "Sambata", "Duminică", "Duminica",
        "Ianuarie", "Februarie", "Martie", "Aprilie", "Mai", "Iunie", "Iulie", "August", "Septembrie", "Octombrie", "Noiembrie", "Decembrie", "Crăciun", "Craciun", "Paște", "Paste",
    ],
    "remember": [r"și-a\s+amintit", r"si-a\s+amintit", r"își\s+amintea", r"isi\s+amintea", "amintit", "amintire", "odinioară", "odinioara", "demult", r"în\s+trecut", r"in\s+trecut"],
    "perception": [r"a\s+văzut", r"a\s+vazut", "văzut", "vazut", r"a\s+auzit", "auzit", r"a\s+simțit", r"a\s+simtit", "observat", "urmărit", "urmarit"],
    "reporting": [r"a\s+spus", "spus", r"a\s+întrebat", r"a\s+intrebat", "întrebat", "intrebat", r"a\s+răspuns", r"a\s+raspuns", "răspuns", "raspuns", r"a\s+scris", "scris", r"a\s+explicat", "explicat"],
    "intention": [r"a\s+încercat", r"a\s+incercat", "încercat", "incercat", r"a\s+decis", "decis", r"a\s+planificat", "planificat", r"a\s+promis", "promis", r"a\s+început", r"a\s+inceput", "început", "inceput"],
    "cognition": [r"s-a\s+gândit", r"s-a\s+gandit", "gândit", "gandit", r"a\s+crezut", "crezut", r"a\s+știut", r"a\s+stiut", "știut", "stiut", r"a\s+imaginat", "imaginat", r"a\s+sperat", "sperat", r"a\s+temut", "temut"],
    "state": ["este", "sunt", "era", "erau", "fi", "fost", "trăiește", "traieste", "locuiește", "locuieste", "locuia", "are", "avea"],
    "supposition": ["poate", "probabil", r"ar\s+putea", r"ar\s+fi", r"și-ar\s+fi\s+imaginat", r"si-ar\s+fi\s+imaginat", "dacă", "daca"],
    "general": ["întotdeauna", "intotdeauna", "niciodată", "niciodata", r"de\s+obicei", r"în\s+general", r"in\s+general", r"toată\s+lumea\s+știe", r"toata\s+lumea\s+stie"],
    "fiction": [r"în\s+poveste", r"in\s+poveste", r"în\s+roman", r"in\s+roman", r"în\s+film", r"in\s+film", "fictiv", "inventat"],
    "join": ["întâlnit", "intalnit", "găsit", "gasit", "reunit", r"s-au\s+întâlnit", r"s-au\s+intalnit"],
    "split": ["plecat", "separat", "dispărut", "disparut", "singur", r"a\s+părăsit", r"a\s+parasit", r"s-a\s+despărțit", r"s-a\s+despartit"],
    "parallel": [r"între\s+timp", r"intre\s+timp", r"în\s+altă\s+parte", r"in\s+alta\s+parte", "simultan", r"în\s+același\s+timp", r"in\s+acelasi\s+timp"],
    "retrospective": [r"cu\s+(?:\d+\s+\w+|ani|mult\s+timp)\s+(?:în\s+urmă|in\s+urma)", r"mai\s+devreme", "odinioară", "odinioara", "demult", r"în\s+trecut", r"in\s+trecut", "înainte", "inainte"],
    "sequential": ["apoi", r"după\s+aceea", r"dupa\s+aceea", "atunci", r"pe\s+urmă", r"pe\s+urma"],
    "forward": [r"mai\s+târziu", r"mai\s+tarziu", "după", "dupa", r"în\s+cele\s+din\s+urmă", r"in\s+cele\s+din\s+urma"],
    "perfective": [r"(?:a|au|am|ai|ați|ati)\s+\w+(?:at|it|ut)"],
    "progressive": [r"(?:este|era|sunt|erau)\s+(?:în\s+curs\s+de|in\s+curs\s+de)"],
    "negative": ["nu", "niciodată", "niciodata", "n-a", "n-au", "n-am"],
    "duration": [r"(?:timp\s+de\s+)?\d+\s+(?:secundă|secunda|secunde|minut|minute|oră|ora|ore|zi|zile|săptămână|saptamana|săptămâni|saptamani|lună|luna|luni|an|ani)"],
    "clock": ["zori", "amiază", "amiaza", r"miezul\s+nopții", r"miezul\s+noptii", "noapte", "dimineață", "dimineata", "seară", "seara", r"\d{1,2}:\d{2}"],
    "recurring": ["întotdeauna", "intotdeauna", r"de\s+obicei", "adesea", r"în\s+fiecare\s+\w+", r"in\s+fiecare\s+\w+"],
}

#: Words that begin sentences; an entity of such words alone is none.
EN_STOPWORDS = [
    "A", "An", "And", "After", "At", "Before", "During", "Earlier", "Elsewhere", "Finally", "He", "Her", "His", "In", "Later", "Meanwhile", "On", "She",
    "The", "Then", "They", "This", "When", "While", "Years", "Now", "Last", "Tomorrow", "Today", "Yesterday", "From", "To",
]
RO_STOPWORDS = [
    "A", "Al", "Ale", "Ai", "Acest", "Aceasta", "Apoi", "Atunci", "Ani", "An", "Astăzi", "Astazi", "Azi", "Când", "Cand", "Către", "Catre", "Cu", "Dar", "De", "Demult", "Din",
    "După", "Dupa", "Ea", "El", "Ele", "Ei", "În", "In", "Înainte", "Inainte", "Între", "Intre", "Ieri", "La", "Lui", "Mai", "Mâine", "Maine", "O", "Pe", "Pentru", "Prin",
    "Spre", "Și", "Si", "The", "Un", "Odinioară", "Odinioara",
]

#: Parts of a time expression that tell its value, in the order in which they are tried.
TIMEX_VALUES: list[tuple[str, list[str]]] = [
    ("PRESENT_REF", ["today", "now", "astăzi", "astazi", "azi", "acum"]),
    ("FUTURE_REF", ["tomorrow", "next", "later", "mâine", "maine", "mai târziu", "mai tarziu", "viitor"]),
    ("PAST_REF", ["yesterday", "earlier", "ago", "before", "long ago", "back then", "ieri", "înainte", "inainte", "urmă", "urma", "demult", "odinioară", "odinioara"]),
]

#: Aliases of languages; anything else is English where no check is asked for.
ALIASES = {"en": ["en", "eng", "english"], "ro": ["ro", "ron", "rom", "romanian", "română", "romana"]}

# The vocabulary of the plain rules that other toolkits are compared with.
COMPARED: dict[str, list[str]] = {
    "anchor": [
        "now", "today", "yesterday", "tomorrow", "earlier", "years earlier", "long ago", r"last\s+\w+", r"next\s+\w+", r"before\s+(?:the\s+)?\w+", r"after\s+(?:the\s+)?\w+", "while", "when",
        r"\d+\s+(?:year|years|month|months|week|weeks|day|days|hour|hours)\s+(?:old|ago)", r"\d{4}", "Christmas", "Thanksgiving",
    ],
    "conjunction": ["and then", "but", "yet", "so", "when", "while", "because"],
    "verb": [
        "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "shall", "would", "could", "might", "must", "can",
        "grew", "came", "come", "go", "went", "walks?", "walked", "walking", "travels?", "traveled", "travelled", "searches?", "searched", "finds?", "found", "remembers?", "remembered",
        "recalls?", "recalled", "lives?", "lived", "opens?", "opened", "disappears?", "disappeared", "left", "leave", "met", "meet", "looks?", "looked", "waits?", "waited", "carried",
        "played", "won", "called", r"\w+(?:ed|ing)",
    ],
    "future": EN["future"],
    "past": [
        "had", "was", "were", "did", "grew", "found", "saw", "came", "went", "left", "met", "thought", "won", "played", "called", "remembered", "recalled",
        "years earlier", "earlier", "long ago", "ago", "yesterday", r"last\s+\w+", r"before\b", r"\w+ed",
    ],
    "simultaneous": ["meanwhile", "while", "at the same time", "simultaneously"],
    "after": ["after", "then", "later", "afterward", "afterwards"],
    "before": ["before", "until", "earlier"],
    "place_preposition": EN["place_preposition"],
}
COMPARED_STOPWORDS = ["A", "An", "And", "He", "She", "They", "This", "When", "While", "Years", "Now", "Last", "Tomorrow"]

# Words of patterns: verbs of the mind that tell a viewpoint, articles before places, and the Romanian preposition of surfaces; Romanian letters.
EN_VIEWPOINT = ["wondered", "thought", "remembered", "imagined", "believed", "saw", "heard"]
RO_VIEWPOINT = [r"s-a\s+gândit", r"s-a\s+gandit", r"și-a\s+amintit", r"si-a\s+amintit", r"a\s+crezut", r"a\s+văzut", r"a\s+vazut", r"a\s+auzit"]
RO_ARTICLES = ["un", "o", "același", "aceeași", "acelasi", "aceeasi", "the"]
RO_SURFACE = "pe"
RO_UPPER, RO_LOWER = "A-ZĂÂÎȘȚ", "ăâîșț"

# End of fixed values.

LANGUAGES = {"en": EN, "ro": RO}


@dataclass(frozen=True)
class Pattern:
    body: str
    ignore_case: bool = True
    #: The same language and the same matches, in a form that backtracking engines try faster.
    grouped: str | None = None

    @property
    def java(self) -> str:
        return ("(?iU)" if self.ignore_case else "(?U)") + (self.grouped or self.body)

    @property
    def re2(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.body


def any_of(entries: list[str]) -> str:
    return "(?:" + "|".join(entries) + ")"


def grouped(entries: list[str]) -> str:
    """As :func:`any_of`, with entries of one first letter under that letter: few branches are tried at a place.

    The first entry that matches still wins: entries of different letters exclude each other, those of one letter keep their order, and none is moved
    past an entry that begins with anything but a plain letter.
    """
    groups: list[tuple[str | None, list[str]]] = []
    at: dict[str, int] = {}
    for e in entries:
        if len(e) < 2 or not (e[0].isascii() and e[0].isalpha() and e[1].isalpha()):
            at.clear()
            groups.append((None, [e]))
        elif e[0].lower() in at:
            groups[at[e[0].lower()]][1].append(e[1:])
        else:
            at[e[0].lower()] = len(groups)
            groups.append((e[0], [e[1:]]))
    return any_of([rest[0] if c is None else c + (rest[0] if len(rest) == 1 else any_of(rest)) for c, rest in groups])


@lru_cache
def cue(name: str, lang: str = "en") -> Pattern:
    """Any entry of a vocabulary, as whole words."""
    words = (COMPARED if lang == "compared" else LANGUAGES[lang])[name]
    return Pattern(rf"\b{any_of(words)}\b", grouped=rf"\b{grouped(words)}\b")


@lru_cache
def boundary(lang: str = "en") -> Pattern:
    """What separates clauses."""
    words = any_of((COMPARED if lang == "compared" else LANGUAGES[lang])["conjunction"])
    ends = r"(?<=[.!?])\s+|" if lang == "compared" else ""
    return Pattern(rf"{ends}[,;]\s+|\s+\b{words}\b\s+")


@lru_cache
def place(lang: str = "en") -> Pattern:
    """A preposition and a place, which is group 1."""
    if lang != "ro":
        some = r"[a-z]+(?:\s+[a-z]+)?"
        return Pattern(rf"\b{any_of(EN['place_preposition'])}\s+(the\s+{some}|a\s+{some}|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)")
    some, low = r"\p{L}+(?:\s+\p{L}+)?", f"[a-z{RO_LOWER}]+"
    name = rf"[{RO_UPPER}](?:(?-i:\p{{Ll}})|[{RO_LOWER}])+"
    kinds = [rf"{a}\s+{some}" for a in RO["place_article"]] + [rf"{name}(?:\s+{name})?", rf"{low}(?:\s+{low})?"]
    return Pattern(rf"\b{any_of(RO['place_preposition'])}\s+({'|'.join(kinds)})")


RO_ON = Pattern(rf"\b{RO_SURFACE}\s+([a-z{RO_LOWER}]+(?:\s+[a-z{RO_LOWER}]+)?)\b")


@lru_cache
def entity(lang: str = "en") -> Pattern:
    """One or two words that begin with a capital."""
    name = rf"[{RO_UPPER}][\p{{Ll}}{RO_LOWER}]+" if lang == "ro" else "[A-Z][a-z]+"
    return Pattern(rf"\b{name}(?:\s+{name})?\b", False)


@lru_cache
def viewpoint(lang: str = "en") -> Pattern:
    """A name, which is group 1, and a verb of the mind."""
    if lang != "ro":
        return Pattern(rf"\b([A-Z][a-z]+)\s+({'|'.join(EN_VIEWPOINT)})\b", False)
    return Pattern(rf"\b([{RO_UPPER}](?:(?-i:\p{{Ll}})|[{RO_LOWER}])+)\s+({'|'.join(RO_VIEWPOINT)})\b")


@lru_cache
def place_before(lang: str = "en") -> tuple[str, str]:
    """What may stand before a place's name, and after it."""
    words = any_of(LANGUAGES[lang]["place_preposition"])
    article = rf"(?:{'|'.join(RO_ARTICLES)})?\s*" if lang == "ro" else r"(?:the\s+)?"
    return rf"\b{words}\s+{article}", r"\b"
