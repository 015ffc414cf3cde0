"""Problem 2: personal information inside free text.

Generators (``personal_spans``) propose overlapping spans of emails, phone numbers, identity numbers,
addresses and names; gradient-boosted trees judge each from its format and context; per-kind
thresholds, calibrated on held-out texts, select; overlaps go to the likelier, then longer span.
The trees are fitted on the driver from ``TRAIN_TEXTS`` texts composed here from sentence frames, with
the known name parts and invented ones; the model is a few kilobytes and is broadcast.

Defined results: a null text has no items and stays null; an empty text stays empty; rows that repeat
an id are one record; the text outside the placeholders is unchanged; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import spread
from .boosting import Boosted
from .personal_spans import KINDS, Names, automaton, candidates

TRAIN_TEXTS = 5000
_BREAK_TIE = {"email": 4, "address": 3, "name": 2, "id_number": 1, "phone": 0}

# Sentence frames: {email}, {phone}, {id}, {addr} and {name} are items; the other fields are look-alikes.
_FRAMES = """
Please write to {email} before noon.|Contact: {email}; they prefer mail.|Mail from {email}, sent twice.|{name} <{email}> agreed.|Answer to <{email}> about {ticket}.
The login {email} was closed.|mailto:{email} came back.|Correo {email}.|Schreiben an {email} bis Montag.|The account of {email} is new, see {ticket}.
Reach me at {email} or {phone}.|{name} can be reached at {email} or {phone}.|Signed: {name}, {phone}, {email}|signed, {name}, {email}
Phone: {phone}.|Tel. {phone}|Call {phone} after nine.|call notes, {phone}|Rückruf unter {phone} nach {clock} Uhr.|Llamar al {phone} hoy.|Joignable au {phone} dès {clock}.|Text {phone} if it fails.
The number {phone} belongs to the desk.|tel {phone}, ask for the desk.|She gave {phone} as mobile number.|mobile {phone}|reported by {name} ({phone})|Fax {phone} and {phone}.|Please ring {phone}
SSN {id} is stored.|Passport {id} expires soon.|Identity card no. {id} was scanned.|personal ID: {id}|intake sheet, ID {id}|Tax id {id} was listed.|National insurance number {id} was read.|Customer {name} ({id}) lives at {addr}.
Datos de {name}: DNI {id}, correo {email}.|Personalausweis {id} liegt vor.|The form shows tax id {id} and more.|NIE {id} recibido.|SSN on file is {id}.|DNI {id}
Home address: {addr}.|They moved to {addr} in {month}.|Deliver to {addr} from now on.|Delivery for {ticket} goes to {addr}.|Die neue Anschrift ist {addr}.|La entrega va a {addr}.|Livraison au {addr} pour {ticket}.|Ship it to {addr}.|The meeting is at {addr}, {day} {clock}.|letter sent from {addr}
Booking for {name}, {addr}, phone {phone}.|Kontakt: {name}, {addr}, Tel. {phone}.|scan of the form signed by {name}, {addr}
chat with {name}|imported for {name} <{email}>|Met Ms. {name} and agreed.|Dr. {name} will present it in {month}.|Cc {name} on anything about {setting}.|The request came from {name} on {day}.|Owner of {ticket}: {name}.|Lo pidió {name} en {ticket}.|À revoir avec {name} avant {clock}.|Bitte {name} fragen, bevor {ticket} fertig ist.
{name} changed the {word} {word} in {month}.|Thanks to {name} for the {word}.|{name} and {name} met on {day}.|We asked {name} about {setting}.|{name} wrote the {word}.|Mr. {name} called|according to {name}, it works|{name}
The DSN is svc:hidden@db-{n3}.test:5432/main for {service}.|ssh deploy@10.2.{n3}.{n1} works.|ssh {word}@{service}.internal and run it.|Pinned {service}@{n1}.{n3}.{n1} after {ticket}.|Thanks to @{word}-crew for {ticket}.|Use {word}@{n1}.{n1}.{n1} or later.|git@{service}.test:{word}/{word}.git is the remote.|postgres://{word}:secret@{service}.test:5432/{word}|scp x root@{service}.test:/tmp
Ask at {clock} in {file}.|Look at {file} and {service}.|It broke at {service} dot release.|Write to alerts-at-night only if latency passes {n2}.{n1} percent.
Part number {n3}-{n2}-{n4} is out of stock.|Orders {n3}-{n3} to {n3}-{n3} belong to {ticket}.|Build {n3}.{n2}.{n3} passed at {clock}.|Timestamps like 2024-03-{n2} {clock}:{n3} confuse it.|IP {n3}.{n1}.{n3}.{n1} answered {n3} times.|Account {n4}{n4}{n4}{n1} was merged on {day}.|Commit 9f3c{n3}ab{n2}e1 touched {file}.|Drive {n2} bay {n3} failed.
order {n9} shipped on {day}.|Invoice {n9} is open.|Case {n3}-{n2}-{n4} was closed.|Batch {n9} ran {n3} times.|{n4}-{n2}-{n2} {clock}|version {n1}.{n3}.{n4}|ref {n3} {n2} {n4} in the log|serial AB{n9}|SKU {word} X{n4}{n3}B is listed.|tracking {n9}|package id {n9}|row {n9} of {n9}
Lane {n3} of the {service} board is full.|Street level data for {month} covers {n3} rows.|Drive {n2} failed at {n1} percent.|We put {n2} items in place {n1} and court {n1}.|{n3} rows per lane.|Version {n1} way {n2}.|{n3} of the road maps.|Take {n2} hours on the road.|It covers {n2} sprints, the best way so far.
Will the {word} from {month} survive, or will Dawn jobs drop it?|Mark the {word} {word} as done and Grant read access to {word}.|Rose {word} and Will ask.|{Service} reported {n3} rows of drift on {day}.|During the {day} sync {word} called it done.|The {Word} Review in {Month} was short.|Next step: {word} work.|Decision: {service} moves to v{n1}.{n2}.{n1}.
Please keep the {word} next to {file}.|Setting {setting} to {n3} cut drift by {n2}.{n1} percent.|Half of the {word} belongs to {ticket}, the rest to {ticket}.|Die alte {Word} aus {service} wurde am {clock} Uhr gekürzt.|Nach {n3} Versuchen lief {service} wieder.|Después de {n3} intentos volvió {service}.|Après {n3} essais, {service} est reparti.|{Word} {Word} {Word} {Word} at {clock}|Project {Word} {Word} starts in {month}.|{Word} Server and {Word} Gateway are slow.
{n3} {word} later. If row count grows, wait.|Sie hat {n3} Einträge. Street level {word}.|{n3} entrées. Le court {word} de {service}.|{n3} minutes et le court {word}.|{n2} retries in place of {word}.|{n3} {word} rows. Drive on.|{n2} {word} square {word}
the old {word} moved|ask the {word} team|reported by the {word} desk|one two {word} three|chat with the {word} group|signed by the {word} team|booking for {month}|imported for {Word} {Word}|met the {Word} Team|customer {word} {word}
"""
_FRAMES = [f.strip() for line in _FRAMES.strip().splitlines() for f in line.split("|") if f.strip()]
_WORDS = "summary draft report index cache planner window token schema digest budget contract outline memo recipe ledger bridge probe survey backlog agenda fixture prompt replica export threshold garden kitchen travel support search mobile".split()
_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_OTHER_GIVEN = "Clara Mateo Pierce Bruno Joy Elif Marc Sofia Paul Irene Oskar Amelie Jonas Pilar Noah Marta Ruth Emil Chloe Ines".split()


_OTHER_FAMILY = "Leclair Moreau O'Brien Novak Fischer Delacroix Lindqvist Marchetti Álvarez Keller Dupont Castellan Bérenger O'Malley Sørensen Winter Hartley Lozano".split()
_SPELLED = "zero one two three four five six seven eight nine".split()


class _Composer:
    """Texts with known items, drawn from the frames."""

    def __init__(self, parts: list[tuple[str, str]], seed: int):
        self.r = random.Random(seed)
        self.given = sorted({p for p, k in parts if p and k == "given"}) or _OTHER_GIVEN
        self.family = sorted({p for p, k in parts if p and k == "family"}) or ["Trevmox"]
        self.heads = sorted({f[: n] for f in self.family for n in (3, 4) if len(f) > 6})
        self.tails = sorted({f[-n:] for f in self.family for n in (3, 4, 5, 6) if len(f) > 7 and sum(g.endswith(f[-n:]) for g in self.family) >= 4}) or ["mox"]

    def number(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def name(self) -> str:
        r = self.r
        given = r.choice(self.given if r.random() < 0.75 else _OTHER_GIVEN)
        family = r.choice(self.family) if r.random() < 0.6 else r.choice(self.heads) + r.choice(self.tails)
        if r.random() < 0.2:
            family = r.choice(_OTHER_FAMILY)
        if r.random() < 0.12:
            family += "-" + r.choice(self.family)
        elif r.random() < 0.06:
            family = r.choice(("de la ", "van der ", "von ", "del ")) + family
        mid = f" {r.choice('ABCDEKLMPRST')}." if r.random() < 0.15 else ""
        k = r.random()
        s = f"{given}{mid} {family}" if k < 0.62 else f"{family}, {given}{mid}" if k < 0.82 else f"{given[0]}. {family}" if k < 0.95 else f"{family}, {given[0]}."
        k = r.random()
        return s.upper() if k < 0.07 else s.lower() if k < 0.14 and "." not in s else s

    def email(self) -> str:
        r = self.r
        sep = r.choice(("", ".", "_", "-"))
        a, b = r.choice(self.given).lower(), r.choice(self.family).lower().replace(" ", "")
        local = r.choice((a + sep + b, b + sep + a, a[0] + b, a + self.number(2), a + "." + b + "+" + r.choice(_WORDS)))
        host = r.choice(("", "", "mail.")) + r.choice(_WORDS) + r.choice(("", "-mail", "")) + r.choice((".example", ".test", ".invalid", ".com", ".org", ".co.uk"))
        k = r.random()
        if k < 0.62:
            s = f"{local}@{host}"
        elif k < 0.72:
            s = f"{local} (at) {host.replace('.', ' (dot) ')}"
        elif k < 0.8:
            s = f"{local}[at]{host}"
        elif k < 0.92:
            s = f"{local} at {host.replace('.', ' dot ')}"
        else:
            s = f"{local} @ {host}"
        return s.upper() if r.random() < 0.06 else s

    def phone(self) -> str:
        n = self.number
        if self.r.random() < 0.08:
            return " ".join(_SPELLED[int(c)] for c in n(10))
        return self.r.choice((f"+1 ({n(3)}) 555-0{n(3)}", f"({n(3)}) 555-0{n(3)}", f"({n(3)}) 555 0{n(3)}", f"{n(3)}-555-0{n(3)}", f"{n(3)}.555.0{n(3)}", f"+1{n(3)}5550{n(3)}", f"1 {n(3)} 555 0{n(3)}", f"+1 {n(3)} 555 0{n(3)}", f"01632 960{n(3)}", f"020 7946 0{n(3)}", f"+44 20 7946 0{n(3)}", f"+49 30 23125 {n(3)}", f"+33 1 99 00 {n(2)} {n(2)}", f"+34 9{n(2)} {n(3)} {n(3)}", f"0{n(3)} {n(7)}"))

    def id(self) -> str:
        n, c = self.number, lambda: self.r.choice("ABCDEFGHJKLMNPRSTVXYZ")
        return self.r.choice((f"9{n(2)}-{n(2)}-{n(4)}", f"9{n(2)} {n(2)} {n(4)}", f"9{n(8)}", f"{c()}{c()} {n(2)} {n(2)} {n(2)} {c()}", f"{c()}{c()}{n(6)}{c()}", f"{c()}{n(6)}{c()}", f"X{n(7)}{c()}", f"{c()}{c()}{n(7)}", f"{n(2)}.{n(2)}.{n(6)}-{n(2)}", f"{n(8)}{c()}", f"C{n(8)}"))

    def addr(self) -> str:
        r = self.r
        w = r.choice("Fenwick Carding Barrow Quill Tindle Marrow Sedge Lowmere Hollin Maple Stone Castle Linden Birch Rosen Market".split())
        if r.random() < 0.5:
            w2 = w + r.choice((" Hill", " Mill", " Orchard", " Park"))
        else:
            w2 = w
        no = str(r.randint(1, 999)) + r.choice(("", "", "", "a", "b"))
        unit = r.choice(("", "", "", f", Apt {r.randint(1, 30)}{r.choice('ABC')}", f", Unit {r.randint(1, 60)}", f", Suite {r.randint(1, 60)}"))
        s = r.choice((f"{no} {w2} Street{unit}", f"{no} {w2} Avenue{unit}", f"{no} {w2} Lane{unit}", f"{no} {w2} Rd{unit}", f"{no} {w2} Ct.{unit}", f"{no} {w2} Road{unit}", f"{w}straße {no}", f"{w}weg {no}", f"Calle {w2} {no}", f"{no} rue {w}"))
        return s.upper() if r.random() < 0.05 else s

    def text(self) -> tuple[str, set[tuple[int, int, int]]]:
        r = self.r
        out, gold = "", set()
        for _ in range(r.randint(1, 3)):
            frame = r.choice(_FRAMES)
            at = 0
            while at < len(frame):
                j = frame.find("{", at)
                if j < 0:
                    out += frame[at:]
                    break
                out += frame[at:j]
                e = frame.index("}", j)
                field, at = frame[j + 1 : e], e + 1
                low = field.lower()
                if field in ("email", "phone", "id", "addr", "name"):
                    value = getattr(self, field)()
                    gold.add(({"email": 0, "phone": 1, "id": 2, "addr": 3, "name": 4}[field], len(out), len(out) + len(value)))
                elif field[0] == "n" and field[1:].isdigit():
                    value = self.number(int(field[1:]))
                elif low == "word":
                    value = r.choice(_WORDS)
                elif low == "month":
                    value = r.choice(_MONTHS)
                elif low == "day":
                    value = r.choice(_DAYS)
                elif low == "clock":
                    value = f"{r.randint(0, 23):02}:{r.randint(0, 59):02}"
                elif low == "ticket":
                    value = r.choice(("MEM", "DOC", "OPS", "QX")) + "-" + self.number(r.randint(3, 4))
                elif low == "service":
                    value = r.choice(_WORDS) + "-" + r.choice(_WORDS)
                elif low == "file":
                    value = r.choice(_WORDS) + "/" + r.choice(_WORDS) + "_x.py"
                else:
                    value = r.choice(_WORDS) + "_" + r.choice(_WORDS) + "_limit"
                out += value.capitalize() if field[0].isupper() else value
            out += r.choice((" ", "\n", "  "))
        k = r.random()
        cased = out.upper() if k < 0.06 else out.title() if k < 0.1 else out
        return cased if len(cased) == len(out) else out, gold


@dataclass
class Model:
    """Trees and thresholds by kind, and what is known of names."""

    names: Names
    trees: list[Boosted | None]

    def prepare(self):
        return automaton(self.names)

    def select(self, texts: list[str | None], hits) -> list[list[tuple[int, int, int]]]:
        """The chosen (start, end, kind) spans of each text, in order; spans of a text don't overlap."""
        rows: list[tuple[int, int, int, int]] = []
        feats: list[list[list[float]]] = [[] for _ in KINDS]
        where: list[list[int]] = [[] for _ in KINDS]
        for i, t in enumerate(texts):
            if t:
                for kind, a, b, f in candidates(t, self.names, hits):
                    where[kind].append(len(rows))
                    feats[kind].append(f)
                    rows.append((i, kind, a, b))
        score = np.zeros(len(rows))
        for k, model in enumerate(self.trees):
            if model is not None and feats[k]:
                p = model.predict(np.array(feats[k]))
                score[where[k]] = np.where(p >= model.threshold, p - model.threshold + 1e-6, 0)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for j in sorted(np.flatnonzero(score > 0).tolist(), key=lambda j: (-round(score[j], 1), -(rows[j][3] - rows[j][2]), -_BREAK_TIE[KINDS[rows[j][1]]], rows[j])):
            i, kind, a, b = rows[j]
            if all(b <= x or y <= a for x, y, _ in out[i]):
                out[i].append((a, b, kind))
        return [sorted(z) for z in out]


def train(parts: list[tuple[str, str]], texts: int = TRAIN_TEXTS, seed: int = 17) -> Model:
    """Fit the trees of every kind on composed texts; a fifth of the texts calibrates the thresholds."""
    names = Names.learn(parts)
    hits = automaton(names)
    # The composer also invents names that are not listed, so that those are learned too.
    composer = _Composer(parts, seed)
    x: list[list[list[float]]] = [[] for _ in KINDS]
    y: list[list[float]] = [[] for _ in KINDS]
    group: list[list[int]] = [[] for _ in KINDS]
    for i in range(texts):
        text, gold = composer.text()
        for kind, a, b, f in candidates(text, names, hits):
            x[kind].append(f)
            y[kind].append(float((kind, a, b) in gold))
            group[kind].append(i)
    trees: list[Boosted | None] = []
    for k in range(len(KINDS)):
        if len(set(y[k])) < 2:
            trees.append(None)
            continue
        xs, ys, held = np.array(x[k]), np.array(y[k]), np.array(group[k]) % 5 == 0
        trees.append(Boosted().fit(xs[~held], ys[~held]).calibrate(xs[held], ys[held]))
    return Model(names, trees)


def _fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    return spread(df.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)])).where(F.col("id").isNotNull())


#: Rows of the list of names that are sent to every executor; a longer list is refused, not cut.
MOST_PARTS = 20_000


def _shared(df: DataFrame, name_parts: DataFrame):
    parts = [(r[0], r[1]) for r in name_parts.select("name_part", "part_kind").distinct().orderBy("name_part", "part_kind").limit(MOST_PARTS + 1).collect()]
    if len(parts) > MOST_PARTS:
        raise ValueError(f"name_parts has more than {MOST_PARTS} rows; the list is sent to every executor")
    return df.sparkSession.sparkContext.broadcast(train(parts))


def find(df: DataFrame, name_parts: DataFrame, *, id_col: str = "id", fields: list[str] | None = None) -> DataFrame:
    """(id, field_name, kind, item_text): the distinct items of each field of each record."""
    fields = fields or ["content", "source_description"]
    rows = _fields(df, id_col, fields)
    kind_of_id = dict(rows.dtypes)["id"]
    model = _shared(df, name_parts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = model.value.prepare()
        for b in batches:
            at, field, kind, item = [], [], [], []
            for k, name in enumerate(fields):
                texts = b.column(f"f{k}").to_pylist()
                for i, spans in enumerate(model.value.select(texts, hits)):
                    for s in {(KINDS[z], texts[i][x:y]) for x, y, z in spans}:
                        at.append(i), field.append(name), kind.append(s[0]), item.append(s[1])
            if at:
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(field), pa.array(kind), pa.array(item)], names=["id", "field_name", "kind", "item_text"])

    return rows.mapInArrow(scan, f"id {kind_of_id}, field_name string, kind string, item_text string").distinct()


def redact(df: DataFrame, name_parts: DataFrame, *, id_col: str = "id", fields: list[str] | None = None) -> DataFrame:
    """(id, <fields>): one row for each record, every item replaced by ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` or ``[NAME]``."""
    fields = fields or ["content", "source_description"]
    rows = _fields(df, id_col, fields)
    kind_of_id = dict(rows.dtypes)["id"]
    model = _shared(df, name_parts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = model.value.prepare()
        for b in batches:
            columns = [b.column("id")]
            for k in range(len(fields)):
                texts = b.column(f"f{k}").to_pylist()
                for i, spans in enumerate(model.value.select(texts, hits)):
                    for x, y, z in reversed(spans):
                        texts[i] = f"{texts[i][:x]}[{KINDS[z].upper()}]{texts[i][y:]}"
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", *fields])

    columns = ", ".join(f"`{c}` string" for c in fields)
    return rows.mapInArrow(scan, f"id {kind_of_id}, {columns}").dropDuplicates(["id"])
