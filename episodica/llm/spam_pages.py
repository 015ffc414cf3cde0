"""Problem 9: keyword-stuffed pages and link lists, by the shapes of their lines.

Every line, and within long lines every sentence or separated item, is reduced to a shape: its number
of words (in classes), whether it starts with a capital, its separators, links and closing mark.
Neighbouring units of one kind of shape form a block. A block whose units are not sentences, or are
sentences pressed together from a few repeated phrases, is taken for stuffing if enough of its words
are sales words, pack sizes, brand-like compounds or link targets; honest lists, glossaries, logs,
settings and link sections lack those. A page is flagged if the blocks so taken hold more than half
of its words.

Defined results: null ids, null texts and texts without a word are never flagged; repeated rows give
one row; whole texts are used whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import spread

# Fixed list of sales words.
SALES = frozenset(
    "buy cheap best price prices discount free shipping online shop sale sales offer offers deal deals coupon bulk wholesale premium quality new used review reviews top original refurbished compare fast pack order store bargain clearance lowest cheapest bestseller promo promotion save outlet warranty guaranteed "
    "günstig billig kaufen angebot angebote rabatt gutschein versandkostenfrei vergleich test preis bestellen sonderangebot neu gebraucht "
    "barato barata baratos comprar oferta ofertas precio descuento gratis envío tienda rebajas cupón mejor nuevo usado "
    "cher acheter promotion prix livraison gratuite soldes meilleur boutique remise réduction achat neuf occasion".split()
)
# Fixed list of words that hold sentences together.
GLUE = frozenset(
    "the a an of to and in on at for is was were be it that this with from by as or not but we they i you he she its our their has had have will would can when if after before because until while which who than then "
    "der die das und ist war im den dem ein eine mit auf für von zu nicht wir sie er es auch nach bis wenn "
    "el la los las un una y en de que es fue con por para se no su al lo del pero cuando después "
    "le les et est était dans des du une que qui pour par sur avec ne pas il elle nous après avant au aux".split()
)
#: Share of sales words, pack sizes, product tags and brand-like compounds below which no block is stuffed.
QUIET = 0.03
_LINK = re.compile(r"https?://\S+|www\.\S+|<a\s[^>]*>|\]\([^)]*\)", re.I)
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?(?:ul|ol|li|p|div|br|td|tr|table|span|h\d|b|i|em|strong)[^>]*>", re.I)
_SPLIT = re.compile(r"(?<=[.!?])\s+|\s*[|;•·]\s*|\s{2,}\|\s*")
_COMMA = re.compile(r"\s*,\s*")
_PACK = re.compile(r"\b\d+[- ]?(?:pack|pcs|stück|er-pack|pièces|piezas|lot)\b", re.I)
_PRODUCT_TAG = re.compile(r"(?<![^\s,])#(?:" + "|".join(sorted(SALES)) + r")[^\W_]{3,}", re.I)
_BRAND = re.compile(r"\b[A-ZÀ-Þ][a-zà-þ]+(?:Pro|Max|Plus|Shop|Store|Deals|Mart|[A-Z][a-z]+)\b")


def unit_shape(unit: str, words: list[str]) -> tuple:
    """What is left of a unit when its words are dropped: length class, opening, separators, links and closing mark."""
    n = len(words)
    links = len(_LINK.findall(unit))
    return (min(n, 4) if n < 5 else 5 if n < 9 else 6 if n < 20 else 7, unit[:1].isupper(), unit[:1] in "-*[<#", min(links, 2), "|" in unit, ";" in unit, unit.count(",") * 3 >= n > 3, ":" in unit, unit[-1:] in ".!?")


def _units(text: str) -> Iterator[tuple[int, str]]:
    """(line number, unit) of the text: lines, with long ones cut at sentence ends and separators."""
    for k, line in enumerate(_TAG.sub("\n", text).splitlines()):
        line = line.strip()
        if not line:
            continue
        parts = _SPLIT.split(line)
        if len(parts) == 1 and line.count(",") * 4 >= len(line.split()) > 8:
            parts = _COMMA.split(line)
        for p in parts:
            if p and p.strip():
                yield k, p.strip()


def _loud(text: str, tagged: int = 0) -> int:
    """Pack sizes, brand-like compounds and product tags of a text; the tags count if they are ``tagged`` or more."""
    tags = len(_PRODUCT_TAG.findall(text))
    return 2 * len(_PACK.findall(text)) + len(_BRAND.findall(text)) + (tags if tags >= tagged else 0)


def may_be_stuffed(text: str, share: float) -> bool:
    """False only if too few of the words are of those that every stuffed block must have for more than ``share`` of them to stand in such blocks."""
    text = _TAG.sub("\n", text)
    words = _WORD.findall(text.lower())
    return sum(w in SALES for w in words) + _loud(text) >= QUIET * share * len(words)


def stuffed_share(text: str) -> float:
    """The share of the text's words that stand in stuffed blocks."""
    units = [(k, u, [w.lower() for w in _WORD.findall(u)]) for k, u in _units(text)]
    units = [x for x in units if x[2]]
    total = sum(len(w) for _, _, w in units)
    if not total:
        return 0.0
    counts = Counter(w for _, _, ws in units for w in ws if w not in GLUE)
    pairs = Counter(z for _, _, ws in units for z in zip(ws, ws[1:]) if z[0] not in GLUE and z[1] not in GLUE)
    rows = []
    for k, u, ws in units:
        n = len(ws)
        glue = sum(w in GLUE for w in ws)
        link = sum(len(_WORD.findall(m.group())) for m in _LINK.finditer(u))
        sales = sum(w in SALES for w in ws)
        brand = _loud(u, (u.count("#") + 1) // 2)
        again = sum(counts[w] >= 3 and w not in GLUE for w in ws)
        echo = sum(2 for z in zip(ws, ws[1:]) if pairs.get(z, 0) >= 3)
        closed = u[-1:] in ".!?" or u[-2:-1] in ".!?"
        sentence = closed and n >= 4 and (glue / n >= 0.12) and link * 2 < n
        rows.append([k, unit_shape(u, ws), n, glue, link, sales, brand, again, min(echo, n), sentence])
    # Blocks: neighbouring units that are, or are not, sentences.
    taken = 0
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][9] == rows[i][9]:
            j += 1
        block = rows[i:j]
        n, glue, link, sales, brand, again, echo = (sum(r[c] for r in block) for c in range(2, 9))
        if not block[0][9]:
            shapes = Counter()
            for r in block:
                shapes[r[1]] += r[2]
            few = sum(c for _, c in shapes.most_common(6)) / n
            loud = (sales + brand) / n
            # Few shapes dominate a stuffed block; plain word lists need repetition besides sales words.
            if few >= 0.5 and glue / n < 0.25 and (loud >= 0.16 or loud >= 0.06 and (again + link) / n >= 0.3 or loud >= QUIET and min(again, echo) / n >= 0.6 or brand / n >= 0.1):
                taken += n
        else:
            # Sentences are judged one by one: empty phrases repeat their keyword and sales words.
            for r in block:
                if (r[5] + r[6]) / r[2] >= 0.12 and (r[7] + r[5]) / r[2] >= 0.5 and r[8] / r[2] >= 0.25:
                    taken += r[2]
        i = j
    return taken / total


def stuffed_pages(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5) -> DataFrame:
    """(doc_id, stuffed): pages of which more than ``share`` of the words are stuffing, with that share."""
    rows = spread(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).where("doc_id is not null and text is not null")
    kind = dict(rows.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, got = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                s = stuffed_share(text) if may_be_stuffed(text, share) else 0.0
                if s > share:
                    at.append(i)
                    got.append(round(s, 4))
            if at:
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array(got)], names=["doc_id", "stuffed"])

    return rows.mapInArrow(scan, f"doc_id {kind}, stuffed double").dropDuplicates(["doc_id"])
