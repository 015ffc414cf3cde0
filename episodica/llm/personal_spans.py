"""Candidate spans of personal information in one text, and the features of each.

The generators aim at recall: they propose overlapping spans in every spelling a reader would
understand. What is kept is decided by the boosted trees in ``personal``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

KINDS = ("email", "phone", "id_number", "address", "name")

_S = r"(?:[ \t]*\r?\n[ \t]*|[ \t]+)"
_S0 = rf"{_S}?"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_AT = rf"(?:{_S0}@{_S0}|{_S0}[(\[{{]{_S0}(?:at|@){_S0}[)\]}}]{_S0}|{_S}at{_S})"
_DOT = rf"(?:\.|{_S0}[(\[{{]{_S0}(?:dot|\.){_S0}[)\]}}]{_S0}|{_S}dot{_S})"
_EMAIL = re.compile(rf"(?<![\w.+%-])[\w][\w.+%'-]*(?<![.'-]){_AT}{_LABEL}(?:{_DOT}{_LABEL})+", re.I)
_EMAIL_HINT = re.compile(r"@|[(\[{][ \t]*at[ \t]*[)\]}]|\bat\b[^.\n]{1,60}?\bdot\b", re.I)
_PHONE = re.compile(r"(?<![\w@])(?:\+|\(\+?(?=\d{1,5}\)))?\d(?:[ \t().\-/‑–]{0,3}(?:\r?\n[ \t]?)?\d){6,14}(?![\w@])")
_ID = re.compile(
    r"(?<![\w/.-])(?=[A-Z]{0,3}[ -]?\d\d?)(?:\d{3}[- .]\d{2}[- .]\d{4}|\d{3}[- ]?\d{3}[- ]?\d{3}|\d{9}|[A-Z]{2}[ -]?\d\d[ -]?\d\d[ -]?\d\d[ -]?[A-Z]|[A-Z]-?\d{6,8}-?[A-Z]|\d{8}-?[A-Z]|[A-Z]{1,3}\d{6,9}|\d\d\.\d\d\.\d{6}-\d\d|\d{2,3}\.\d{3}\.\d{3}-\d{1,2}|[12] \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?)(?![\w@/-])(?!\.\d)",
    re.I,
)
# Digits spelled out, in the languages of the texts (fixed words).
_DIGITS = "zero oh nought one two three four five six seven eight nine null eins zwei drei vier fünf sechs sieben acht neun cero uno dos tres cuatro cinco seis siete ocho nueve zéro deux trois quatre cinq sept huit neuf".split()
_SPOKEN = re.compile(rf"(?<!\w)(?:plus{_S})?(?:(?:double|triple){_S})?(?:{'|'.join(_DIGITS)})(?:[ \t,.\r\n-]{{1,3}}(?:(?:double|triple){_S})?(?:{'|'.join(_DIGITS)})){{5,17}}(?!\w)", re.I)
_CAPWORD = r"[^\W\d_][\w'’.-]*"
# The point of an abbreviation belongs to the address only where the address goes on.
_STREET = r"(?:(?:street|avenue|lane|road|court|drive|boulevard|place|square|terrace|close|crescent|way|row|walk|mews|parkway)\b|(?:st|ave|ln|rd|ct|dr|blvd|pl|sq|pkwy)\b(?:\.(?=[ \t]*,))?)"
_UNIT = rf"(?:{_S0},?{_S0}(?:apt|apartment|unit|suite|ste|flat|floor|fl|room|rm|piso|wohnung|whg|appt|bât)\b\.?{_S0}#?{_S0}[\w-]+|{_S0},?{_S0}#{_S0}\w+)?"
_ADDRESS = [
    re.compile(rf"(?<![\w./-])\d{{1,5}}[a-z]?(?:-\d+)?{_S}(?:{_CAPWORD}{_S}){{1,4}}?{_STREET}(?!\w){_UNIT}", re.I),
    re.compile(rf"(?<![\w-])[^\W\d_][\w-]*(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|damm|ufer|ring){_S}\d{{1,4}}[a-z]?(?!\w){_UNIT}", re.I),
    re.compile(rf"(?<!\w)(?:calle|avenida|avda\.?|plaza|paseo|camino|carrera|via){_S}(?:{_CAPWORD}{_S}){{1,4}}?(?:,{_S0}|n[.º°]{_S0})?\d{{1,4}}[a-z]?(?!\w){_UNIT}", re.I),
    re.compile(rf"(?<![\w./-])\d{{1,4}}(?:{_S0}(?:bis|ter))?[a-z]?,?{_S}(?:rue|avenue|boulevard|place|chemin|allée|quai|impasse|cours){_S}(?:(?:de|du|des|la|le|les){_S}|d')*{_CAPWORD}(?:-{_CAPWORD})*(?<![.'’-]){_UNIT}", re.I),
]
# Fixed words at which an address is looked for.
_STREET_WORDS = ("street", " st ", " st.", " st,", "avenue", " ave", "lane", " ln", "road", " rd", "court", " ct", "drive", " dr ", " dr.", " dr,", "boulevard", "blvd", "place", " pl ", "square", "terrace", " close", "crescent", " way", " row", " walk", " mews", "parkway", "pkwy", "calle ", "avenida ", "avda", "plaza ", "paseo ", "camino ", "carrera ", "rue ", "chemin ", "allée ", "quai ", "impasse ", "cours ", "straße", "strasse", "str.", "weg ", "gasse ", "allee ", "platz ", "damm ", "ufer ", "ring ")
_TOKEN = re.compile(r"[^\W\d_](?:['’]?[^\W\d_]+)*(?:[-‐][^\W\d_](?:['’]?[^\W\d_]+)*)*\.?|[^\s]")
_PARTICLES = frozenset("de la del los van der den von zu di da della al bin ibn ter le du".split())

# Fixed lists of cue words in the languages of the texts.
_CUES = {
    "phone": "phone tel tel. telephone call calls mobile cell fax text ring reach reached number whatsapp sms rückruf telefon handy llamar teléfono telefono móvil appeler joignable téléphone dial contact".split(),
    "id": "ssn id passport dni nie nif insurance social security tax identity card identification licence license ausweis personalausweis steuer personal national carnet cédula sécurité pasaporte passeport reisepass nino taxpayer citizen resident".split(),
    "address": "address lives live living moved delivery deliver ship shipped send meeting letter home anschrift adresse wohnt entrega livraison dirección domicilio habite parcel mail booking from".split(),
    "name": "for with by from contact kontakt customer patient client signed owner dear met booking chat reported came revoir datos pidió bitte fragen cc attn attention mr ms mrs dr prof herr frau sr sra señor señora mme name called ask hi hello von avec con for:".split(),
    "anti": "part order orders build account timestamp timestamps ip commit version invoice sku ssh dsn port pinned release package model serial batch ref reference tracking case ticket item code hash bay drive lane level range isbn upc amount".split(),
    "title": "mr ms mrs dr prof herr frau sr sra señor señora mme mlle sir madam doctor mr. ms. mrs. dr. prof. sr. sra.".split(),
}
_CUES = {k: frozenset(v) for k, v in _CUES.items()}
_PLAIN = frozenset("the a an and or cc met dear hi hello from for with by contact kontakt customer booking owner signed phone call send write please antwort bitte datos lo von an to on in at of is was if we they this that monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december street lane road avenue court rd ct dr ms mr mrs prof herr frau sr sra home unit apt tel dni id passport ssn number request account text delivery livraison kontakt: next decision version each setting version during between our nobody half after para pour für nach im wir die der das le la el les los to be as done".split())


@dataclass(frozen=True)
class Names:
    """What is known of person names: listed parts, and word endings and beginnings that recur among them."""

    given: frozenset
    family: frozenset
    endings: frozenset
    beginnings: frozenset

    @staticmethod
    def learn(parts: list[tuple[str, str]]) -> Names:
        given = frozenset(p.casefold() for p, k in parts if p and k == "given")
        family_parts = [p.casefold() for p, k in parts if p and k == "family"]
        family = frozenset(family_parts) | frozenset(w for p in family_parts for w in re.split(r"[ -]", p) if len(w) > 3)
        def common(cut, least):
            c = Counter(cut(p, n) for p in family_parts for n in (3, 4, 5) if len(p) >= n + 3)
            return frozenset(s for s, n in c.items() if n >= least)
        return Names(given, family, common(lambda p, n: p[-n:], 4), common(lambda p, n: p[:n], 3))

    def family_like(self, word: str) -> float:
        w = word.casefold().rstrip(".")
        if w in self.family:
            return 1.0
        for part in w.split("-"):
            if part in self.family:
                return 1.0
        end = any(w[-n:] in self.endings for n in (3, 4, 5)) and len(w) >= 6
        begin = any(w[:n] in self.beginnings for n in (3, 4, 5))
        return 0.8 if end and begin else 0.5 if end else 0.2 if begin and len(w) >= 6 else 0.0


def _words_before(text: str, at: int, n: int = 5) -> list[str]:
    return re.findall(r"[^\W_]+[.:]?|[<(@:/#]", text[max(0, at - 48) : at].lower())[-n:]


def _words_after(text: str, at: int, n: int = 3) -> list[str]:
    return re.findall(r"[^\W_]+|[<(@:/>),.]", text[at : at + 30].lower())[:n]


_EDGE = {c: i + 1 for i, c in enumerate("@:/<(>),.-;\"'#=+_")}


def _context(text: str, a: int, b: int) -> list[float]:
    before, after = _words_before(text, a), _words_after(text, b)
    clean = [w.strip(".:") for w in before]
    out: list[float] = []
    for cue in ("phone", "id", "address", "name", "anti", "title"):
        hit = [len(clean) - i for i, w in enumerate(clean) if w in _CUES[cue] or before[i] in _CUES[cue]]
        out.append(float(min(hit)) if hit else 9.0)
    for cue in ("phone", "id", "name", "anti"):
        out.append(float(any(w in _CUES[cue] for w in after)))
    p, q = text[a - 1 : a], text[b : b + 1]
    out += [float(_EDGE.get(p, 0)), float(_EDGE.get(q, 0)), float(p.isalnum()), float(q.isalnum()), float(before[-1:] == [":"] or p == ":" or bool(before) and before[-1].endswith(":")), float(text[b : b + 2].strip()[:1] in "<(" and bool(text[b : b + 2].strip())), float(bool(re.match(r"\d", text[b + 1 : b + 2])))]
    return out


def _format(kind: str, s: str) -> list[float]:
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    groups = re.findall(r"\d+", s)
    out = [float(len(s)), float(digits), float(letters), float(len(groups)), float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0), float(max(map(len, groups), default=0)), float(s[:1] == "+" or s[:2] == "(+"), float("(" in s), float(s.count(".")), float(s.count("-")), float(s.count(" ")), float("/" in s)]
    if kind == "email":
        domain = re.split(r"@|\bat\b", s, maxsplit=1, flags=re.I)[-1]
        labels = re.findall(r"[^\W_][\w-]*", re.sub(r"(?i)[(\[{]\s*dot\s*[)\]}]|\sdot\s", ".", domain))
        last = labels[-1] if labels else ""
        out += [float("@" in s), float(bool(re.search(r"(?i)\bdot\b", s))), float(last.isalpha()), float(len(last)), float(all(x.isdigit() for x in labels[:-1]) if labels[:-1] else 0), float(any(x.isdigit() for x in labels)), float(len(labels)), float(bool(re.match(r"(?i)(deploy|root|svc|git|admin|hidden|user|ubuntu)\b", s)))]
    elif kind == "phone":
        out += [float(len(groups[0]) == 4 and groups[0][:2] in ("19", "20") if groups else 0), float(bool(re.fullmatch(r"\d{3}-\d\d-\d{4}|\d{3} \d\d \d{4}|\d{9}", s))), float(bool(re.fullmatch(r"\d+", s))), float(s[:1] == "0"), float(bool(re.match(r"\+?1?[ .(-]*\d{3}[ ).-]*\d{3}[ .-]*\d{4}$", s))), float(bool(re.match(r"\d{1,3}\.\d{1,3}\.\d{1,3}(\.\d{1,3})?$", s))), float(bool(re.match(r"\d\d\.\d\d\.\d{6}-\d\d$", s))), float(bool(re.match(r"\d{4}-\d\d-\d\d", s)))]
    elif kind == "id_number":
        out += [float(bool(re.fullmatch(r"\d{3}[- .]\d\d[- .]\d{4}", s))), float(bool(re.fullmatch(r"\d{9}", s))), float(bool(re.fullmatch(r"(?i)[a-z]{2}[ -]?\d\d[ -]?\d\d[ -]?\d\d[ -]?[a-z]", s))), float(bool(re.fullmatch(r"(?i)[a-z]-?\d{6,8}-?[a-z]", s))), float(bool(re.fullmatch(r"(?i)[a-z]{1,3}\d{6,9}", s))), float(bool(re.fullmatch(r"\d\d\.\d\d\.\d{6}-\d\d", s))), float(s[:1].isdigit()), float(s[-1:].isalpha())]
    elif kind == "address":
        words = re.findall(r"[^\W\d_]+", s)
        out += [float(s[:1].isdigit()), float(s[-1:].isdigit() or s[-2:-1].isdigit()), float(len(words)), float(sum(w[:1].isupper() for w in words) / max(1, len(words))), float(bool(re.search(r"(?i)\b(apt|unit|suite|flat)\b", s))), float(bool(re.search(r"(?i)\b(calle|rue|avenida|plaza)\b", s))), float(bool(re.search(r"(?i)(straße|strasse|weg)\b", s))), float(any(w.lower() in _PLAIN and w.lower() not in ("street", "lane", "road", "avenue", "court", "rd", "ct", "la", "le", "les", "unit", "apt", "dr") for w in words))]
    return out


def _name_features(text: str, a: int, b: int, shape: str, tokens: list[str], left: bool, right: bool, names: Names) -> list[float]:
    full = [t for t, s in zip(tokens, shape) if s == "C"]
    given = [t.casefold().rstrip(".") in names.given or any(p in names.given for p in t.casefold().split("-")) for t in full]
    fam = [names.family_like(t) for t in full]
    last, first = (0, -1) if "," in shape else (len(full) - 1, 0)
    has_given_slot = len(full) > 1
    near = text[max(0, a - 40) : b + 40]
    letters = [c for c in near if c.isalpha()]
    upper = sum(c.isupper() for c in letters) / max(1, len(letters))
    mine = [c for c in text[a:b] if c.isalpha()]
    own = sum(c.isupper() for c in mine) / max(1, len(mine))
    style = 2.0 if own > 0.9 else 1.0 if all(t[:1].isupper() for t in full) else 0.0
    caps = [w[:1].isupper() for w in re.findall(r"[^\W\d_]+", text[max(0, a - 30) : a] + " " + text[b : b + 30])]
    return [float(sum(given)), fam[last] if full else 0.0, float(given[first]) if has_given_slot else 0.0, fam[first] if has_given_slot else 0.0, float(given[last]) if full else 0.0, float(len(full)), float("I" in shape), float("," in shape), float("P" in shape), style, upper, float(left), float(right), float(full[0].casefold().rstrip(".") in _PLAIN), float(any(t.casefold().rstrip(".") in _PLAIN for t in full)), sum(caps) / max(1, len(caps)), float(min(map(len, full))) if full else 0.0, float(shape[0] == "I")]


_SHAPE = re.compile(r"CI{0,2}P*C|I{1,3}P*C|P*C,CI{0,2}|P*C,I{1,3}")


def _areas(spots: list[tuple[int, int]], size: int, reach: int) -> list[list[int]]:
    """The stretches within ``reach`` of the spots, merged where they meet."""
    out: list[list[int]] = []
    for a, b in spots:
        lo, hi = max(0, a - reach), min(size, b + reach)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _name_spans(text: str, areas: list[list[int]], names: Names) -> list[tuple[int, int, str, list[str], bool, bool]]:
    """Spans around the places where the automaton saw a part of a name or a cue for one."""
    out = []
    for lo, hi in areas:
        while lo > 0 and text[lo - 1].isalnum():
            lo -= 1
        while hi < len(text) and text[hi].isalnum():
            hi += 1
        toks = []
        for m in _TOKEN.finditer(text, lo, hi):
            t = m.group()
            w = t.casefold()
            a, b = m.span()
            if t == ",":
                s = ","
            elif len(t) == 2 and t[1] == "." and t[0].isupper():
                s = "I"
            elif t.endswith(".") and len(t) > 2 or not t[0].isalpha():
                s = "x"
                if t.endswith(".") and t[0].isalpha():
                    w, t, b = w[:-1], t[:-1], b - 1
                    s = "E" if t[:1].isupper() or w in names.given or names.family_like(w) >= 0.5 else "x"
            elif w in _PARTICLES:
                s = "P"
            elif t[0].isupper() and len(t) > 1 or w in names.given or names.family_like(w) >= 0.5:
                s = "C"
            elif len(t) == 1 and t[0].isupper():
                s = "I"
            else:
                s = "x"
            if s != "," and re.search(r"[\w@/.+]$", text[max(0, a - 1) : a]) or re.match(r"[@/_\d]", text[b : b + 1] or " "):
                s = "x"
            toks.append((s, t, a, b))
        # An unlisted given name in lower case is seen by the family name after it.
        for i in range(len(toks) - 1):
            s, t, a, b = toks[i]
            if s == "x" and t.isalpha() and t.islower() and len(t) > 1 and t not in _PLAIN and toks[i + 1][0] in "CE" and toks[i + 1][1][0].islower() and toks[i + 1][2] - b <= 3:
                toks[i] = ("C", t, a, b)
        for i in range(len(toks)):
            if toks[i][0] not in "CIP":
                continue
            shape = ""
            for j in range(i, min(i + 7, len(toks))):
                s, _, a, b = toks[j]
                if j > i and (a - toks[j - 1][3] > 3 or s != "," and a == toks[j - 1][3] and toks[j - 1][0] != "I"):
                    break
                if s == "x":
                    break
                shape += "C" if s == "E" else s
                if len(shape) > 1 and _SHAPE.fullmatch(shape):
                    part = [z[1] for z in toks[i : j + 1]]
                    full = [t for t, z in zip(part, shape) if z == "C"]
                    known = sum(t.casefold() in names.given or names.family_like(t) >= 0.5 for t in full)
                    if known == 0 and not all(t[0].isupper() for t in full):
                        continue
                    left = i > 0 and toks[i - 1][0] in "CIE" and toks[i][2] - toks[i - 1][3] <= 2 and toks[i - 1][1].casefold() not in _PLAIN and text[toks[i - 1][3] : toks[i - 1][3] + 1] != "."
                    nxt = toks[j + 1] if j + 1 < len(toks) else None
                    right = bool(nxt) and s != "E" and nxt[0] in "CIE" and nxt[2] - b <= 2 and nxt[1].casefold() not in _PLAIN
                    stop = b
                    if s == "I" and text[b - 1 : b] != "." and text[b : b + 1] == ".":
                        stop = b + 1
                    out.append((toks[i][2], stop, shape, part, left, right))
                if s == "E":
                    break
    return out


def automaton(names: Names):
    """A function that finds known name parts, name endings and name cues in a lower-cased text."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in sorted(names.endings):
        if len(w) >= 4:
            a.add_word(w, (w, 2))
    for cue in ("signed by", "booking for", "customer ", "contact:", "kontakt:", "signed:", "dr. ", "mr. ", "ms. ", "mrs. ", "prof. ", "herr ", "frau ", "reported by", "chat with", "datos de", "revoir avec", "came from", "imported for", "owner of", "pidió", "cc ", "ask ", "with ", "spoke ", "patient ", "dear ", "met "):
        a.add_word(cue, (cue, 0))
    for w in _STREET_WORDS:
        a.add_word(w, (w, 3))
    for w in _DIGITS:
        if len(w) > 2:
            a.add_word(f" {w} ", (f" {w} ", 4))
    for w in sorted(names.given | names.family):
        a.add_word(w, (w, 1))
    a.make_automaton()
    return a.iter


def candidates(text: str, names: Names, hits) -> list[tuple[int, int, int, list[float]]]:
    """(kind, start, end, features) of every proposed span of ``text``."""
    out: list[tuple[int, int, int, list[float]]] = []

    def add(kind: int, a: int, b: int) -> None:
        s = text[a:b]
        out.append((kind, a, b, _format(KINDS[kind], s) + _context(text, a, b)))

    if _EMAIL_HINT.search(text):
        for m in _EMAIL.finditer(text):
            add(0, *m.span())
    taken = [(a, b) for _, a, b, _ in out]
    for m in _PHONE.finditer(text):
        add(1, *m.span())
    for m in _ID.finditer(text):
        if sum(c.isdigit() for c in m.group()) >= 6:
            add(2, *m.span())
    low = text.lower()
    if len(low) != len(text):  # a few capitals change length; their lower case is left as it is
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    streets, persons, spoken = [], [], []
    for end, (word, edge) in hits(low):
        x, y = end - len(word) + 1, end + 1
        if edge == 3:
            streets.append((x, y))
        elif edge == 4:
            spoken.append((x, y))
        elif not (edge == 1 and (low[x - 1 : x].isalpha() or low[y : y + 1].isalpha()) or edge == 2 and low[y : y + 1].isalpha()):
            persons.append((x, y))
    for lo, hi in _areas(streets, len(text), 90):
        for pattern in _ADDRESS:
            for m in pattern.finditer(text, lo, hi):
                add(3, *m.span())
    for lo, hi in _areas(spoken, len(text), 60):
        for m in _SPOKEN.finditer(text, lo, hi):
            add(1, *m.span())
    if persons:
        for a, b, shape, tokens, left, right in _name_spans(text, _areas(persons, len(text), 45), names):
            if any(x < b and a < y for x, y in taken):
                continue
            out.append((4, a, b, _name_features(text, a, b, shape, tokens, left, right, names) + _context(text, a, b)))
    return out
