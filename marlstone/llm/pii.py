"""PII: high-recall candidate generators, boosted trees over format and context, calibrated thresholds.

All of it runs as DataFrame expressions. The base kinds (email, ip, card, phone) are rules; the method's own kinds are proposed by
loose patterns whose spans may overlap, and boosted trees decide. Every feature is one pattern matched against the span or the
text before it, so the trees see at most ``2**len(FEATURES)`` cells; they are fitted on a built-in, generated set of labelled
spans (``TRAIN_SPANS`` of them) with some from documents, labelled by hand, and compiled to CASE expressions.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import documents, text_or_empty

#: Base kinds in the order in which equal starts are listed. Possessive quantifiers match what the plain ones do and need no stack.
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The method's own kinds; broad on purpose, the narrower first, as it wins a tie.
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "telephone": r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "mail": r"[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "account": r"[0-9](?:[\x20-]?[0-9]){7,}+",
}
#: Guards that are cheap to test: without any of its characters the pattern can't match.
GUARD = {"email": "@", "phone": "+", "mail": "(["}
CONTEXT = 32
#: No pattern of ``GENERATORS`` matches less than this many characters.
LEAST_MATCH = 6
#: Feature: where it is looked for, and a pattern that Java and Python read alike.
FEATURES = {
    "key_word": ("before", r"(?i)(token|secret|passw|api.?key|access.?key|credential|auth)[^a-z]*$"),
    "person_word": ("before", r"(?i)(phone|tel|call|mobile|fax|ssn|social|account|iban|card|konto|cuenta|compte)[^0-9]{0,12}$"),
    "money_word": ("before", r"(?i)(price|total|sum|eur|usd|order|invoice|page|version|isbn|\$|#) ?$"),
    "assigned": ("before", r"[=:] ?[\"']?$"),
    "letter": ("m", r"[A-Za-z]"),
    "digit": ("m", r"[0-9]"),
    "mixed": ("m", r"[0-9][A-Za-z].*[0-9][A-Za-z]|[A-Za-z][0-9].*[A-Za-z][0-9]"),
    "hex": ("m", r"^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"),
    "long": ("m", r"^.{14}"),
    "grouped": ("m", r"[0-9][ .)-]+[0-9]+[ .-][0-9]"),
    "at_sign": ("m", r"[\[(](at|AT)[\])]"),
}
#: Spans that the generators propose in documents, labelled by hand (text before, span, label). They are fitted and calibrated
#: along with the generated ones, each counting ``HAND_WEIGHT`` times.
LABELLED = (
    ('nin onwh and stwh token = "', "84f85083df6ea7c09829aa66c61b0f3fa2c57123", 1),
    ('%%% \u00f1$$$ los&&& token = "', "3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1", 1),
    ("aux \u00e8ch oument\u00e8 r\u00e9pavi anvi la. ", "4214578889459805", 1),
    ("eredstly it thingintion thnding ", "4283063954042639", 1),
    ("le qui. La\u00e8an\u00eaaux oueuxier pour ", "2852466340876421", 1),
    ("des onev\u00e9ngeler de rest on. ", "(768) 555-9731", 1),
    ("schsch&&& ber&&& die&&& ein\u00fc*** ", "daseinheitkeitau", 0),
    (" ntnd thsh. Rest stwh he tirein ", "anndeaanheonesti", 0),
    ("la mente\u00ed una menteco ie osares ", "esmenteezesmiosja", 0),
    ("Tion was ", "Thanonontioniner", 0),
    ('e, token = "d4e71e33b54f40bc277a', "32011430", 0),
    ('eau\u00f3n aier aian token = "34cf1be', "9225426587", 0),
    ("", "ACHLICHKEITEINUNG", 0),
    ("der das des ergeer enungbe\u00fc das ", "sichschvertzlich", 0),
)
HAND_WEIGHT = 20
TRAIN_SPANS = 4000
ROUNDS, RATE = 40, 0.4
PRECISION = 0.95


def training_spans(n: int = TRAIN_SPANS, seed: int = 11) -> list[tuple[str, str, int]]:
    """Generated (text before, span, label): spans that the generators propose, private ones and look-alikes."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    letters = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    mixed = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    plain = lambda: f"{letters(r.randint(2, 8))} {letters(r.randint(2, 8))} "
    keyed = lambda: plain() + r.choice(['token = "', "secret: ", "password=", "api_key = '", "access key: "])
    person = lambda: plain() + r.choice(["phone ", "call ", "tel: ", "account ", "ssn: ", "card no. "])
    money = lambda: plain() + r.choice(["order ", "invoice ", "total ", "price ", "isbn ", "version "])
    tel = lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"
    tel_dots = lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"
    kinds = [
        (8, keyed, lambda: hexes(r.choice([32, 40, 64])), 1),
        (6, keyed, lambda: mixed(r.randint(16, 40)), 1),
        (3, plain, lambda: hexes(40), 1),
        (3, plain, lambda: mixed(r.randint(24, 40)), 1),
        (12, plain, lambda: letters(r.randint(16, 40)), 0),
        (3, plain, lambda: "-".join(letters(r.randint(3, 8)) for _ in range(4)), 0),
        (6, plain, lambda: digits(r.randint(14, 19)), 1),
        (4, person, lambda: digits(r.randint(8, 19)), 1),
        (8, plain, lambda: digits(r.randint(8, 12)), 0),
        (5, money, lambda: digits(r.randint(8, 16)), 0),
        (4, person, lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", 1),
        (4, plain, lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", 1),
        (5, person, tel, 1),
        (5, plain, tel, 1),
        (3, plain, tel_dots, 1),
        (5, money, tel_dots, 0),
        (4, plain, lambda: f"{letters(5)} (at) {letters(6)} (dot) com", 1),
    ]
    picks = r.choices(kinds, [k[0] for k in kinds], k=n)
    return [(before(), span(), label) for _, before, span, label in picks]


def features_of(before: str, m: str) -> tuple[bool, ...]:
    held = {"before": before[-CONTEXT:], "m": m}
    return tuple(bool(re.search(p, held[where])) for where, p in FEATURES.values())


Tree = tuple[int, int, int, tuple[float, float, float, float]]


def boost(cells: dict[tuple[bool, ...], tuple[float, float]], rounds: int = ROUNDS, rate: float = RATE, l2: float = 1.0) -> tuple[float, list[Tree]]:
    """Gradient boosting on the log loss over weighted cells (negatives, positives), each tree two levels deep.

    A tree (i, j, k, leaves) tests feature i, then j where i is false and k where it is true; leaves: (00, 01, 10, 11).
    """
    if not cells:
        return 0.0, []
    neg, pos = sum(c[0] for c in cells.values()), sum(c[1] for c in cells.values())
    start = math.log((pos + 0.5) / (neg + 0.5))
    margin = dict.fromkeys(cells, start)
    width, trees = len(next(iter(cells))), []

    def best(keys: list[tuple[bool, ...]]) -> tuple[float, int, float, float]:
        found = (-1.0, 0, 0.0, 0.0)
        for f in range(width):
            g, h = [0.0, 0.0], [0.0, 0.0]
            for x in keys:
                p = 1 / (1 + math.exp(-margin[x]))
                n = sum(cells[x])
                g[x[f]] += cells[x][1] - n * p
                h[x[f]] += n * p * (1 - p)
            gain = sum(a * a / (b + l2) for a, b in zip(g, h, strict=True))
            if gain > found[0] + 1e-12:
                found = (gain, f, g[0] / (h[0] + l2), g[1] / (h[1] + l2))
        return found

    for _ in range(rounds):
        choice = None
        for i in range(width):
            sides = [[x for x in cells if x[i] == side] for side in (False, True)]
            a, b = (best(s) for s in sides)
            if choice is None or a[0] + b[0] > choice[0] + 1e-12:
                choice = (a[0] + b[0], i, a, b)
        _, i, a, b = choice
        leaves = tuple(round(rate * v, 9) for v in (a[2], a[3], b[2], b[3]))
        trees.append((i, a[1], b[1], leaves))
        for x in cells:
            margin[x] += leaves[2 * x[i] + x[b[1] if x[i] else a[1]]]
    return start, trees


def margin_of(model: tuple[float, list[Tree]], x: tuple[bool, ...]) -> float:
    return model[0] + sum(leaves[2 * x[i] + x[k if x[i] else j]] for i, j, k, leaves in model[1])


@lru_cache(maxsize=1)
def fitted() -> tuple[tuple[float, list[Tree]], float]:
    """The trees, fitted on four fifths of the spans, and the least margin whose precision on the rest is ``PRECISION``."""
    spans = training_spans() + [x for x in LABELLED for _ in range(HAND_WEIGHT)]
    random.Random(3).shuffle(spans)
    rows = [(features_of(b, m), y) for b, m, y in spans]
    cut = len(rows) * 4 // 5
    cells: dict[tuple[bool, ...], tuple[float, float]] = {}
    for x, y in rows[:cut]:
        n, p = cells.get(x, (0.0, 0.0))
        cells[x] = (n + 1 - y, p + y)
    model = boost(cells)
    held = Counter()
    for x, y in rows[cut:]:
        held[margin_of(model, x), y] += 1
    hits = misses = 0
    threshold = 0.0
    for z in sorted({z for z, _ in held}, reverse=True):
        hits, misses = hits + held[z, 1], misses + held[z, 0]
        if hits < PRECISION * (hits + misses) or z < 0:
            break
        threshold = z
    return model, threshold - 1e-6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a one-element transform names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """Inclusive prefix fold of an array, block by block: ``n * (block + n / block**2)`` steps where an array grown by one is ``n**2``."""

    def fold(xs: Column) -> Column:
        return F.aggregate(xs, zero, op)

    def spread(blocks: Column) -> Column:
        def add(heads: Column) -> Column:
            before = F.transform(heads, lambda _, i: fold(F.slice(heads, F.lit(1), i)))
            inner = lambda xs, base: F.transform(xs, lambda _, i: op(base, fold(F.slice(xs, F.lit(1), i + 1))))
            return F.flatten(F.zip_with(blocks, before, inner))

        return let(F.transform(blocks, fold), add)

    def go(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / block).cast("int")), lambda k: F.slice(xs, k * block + 1, F.lit(block)))
        return F.when(F.size(xs) == 0, F.slice(xs, F.lit(1), F.lit(0))).otherwise(let(blocks, spread))

    return let(values, go)


def found_spans(text: Column, pattern: str, guard: str | None, context: bool = False) -> Column:
    """All leftmost non-overlapping matches: array of ``start, stop, m`` (code points, stop exclusive) and, if asked for, ``before``, the
    ``CONTEXT`` characters in front of the match, whatever other matches they hold."""
    kind = "array<struct<start:int,stop:int,m:string" + (",before:string>>" if context else ">>")
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    if guard:
        matches = F.when(reduce(lambda p, q: p | q, [F.contains(text, F.lit(c)) for c in guard]), matches).otherwise(F.array().cast("array<string>"))

    def place(ms: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            stops = running(F.transform(ms, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)), F.lit(0), lambda x, y: x + y)
            if not context:
                return let(stops, lambda at: F.transform(ms, lambda m, i: F.struct((F.get(at, i) - F.length(m)).alias("start"), F.get(at, i).alias("stop"), m.alias("m"))))

            def with_pieces(x: Column) -> Column:
                # No candidate is shorter than ``LEAST_MATCH``, so this many gaps and matches always span the context.
                back = -(-CONTEXT // LEAST_MATCH)

                def span(m: Column, i: Column) -> Column:
                    near = F.array_join(F.slice(x["pieces"], F.greatest(i - back + 1, F.lit(1)), F.least(i, F.lit(back))), "")
                    stop = F.get(x["at"], i)
                    return F.struct((stop - F.length(m)).alias("start"), stop.alias("stop"), m.alias("m"), F.right(F.concat(near, F.get(gaps, i)), F.lit(CONTEXT)).alias("before"))

                return F.transform(ms, span)

            return let(F.struct(stops.alias("at"), F.transform(ms, lambda m, i: F.concat(F.get(gaps, i), m)).alias("pieces")), with_pieces)

        return let(F.split(text, pattern, -1), with_gaps)

    return let(matches, lambda ms: F.when(F.size(ms) == 0, F.array().cast(kind)).otherwise(place(ms)))


def swept(spans: Column) -> Column:
    """``spans``: structs of ``start, rank, stop, kind, fixed, margin``. Fixed ones stay. The others are taken by falling margin (then longer,
    earlier, lower rank) unless they overlap what is fixed or taken already. Returns ``start, rank, stop, kind``, by start and rank.

    Spans are sorted by start once and cut where none reaches over, so a span only meets the run that it overlaps.
    """
    kind = "array<struct<start:int,rank:int,stop:int,kind:string>>"
    bare = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))

    def greedy(run: Column) -> Column:
        order = F.array_sort(F.transform(run, lambda s: F.struct((~s["fixed"]).alias("a"), (-s["margin"]).alias("b"), (s["start"] - s["stop"]).alias("c"), s["start"].alias("d"), s["rank"].alias("e"), s["stop"].alias("f"), s.alias("s"))))
        # Fixed spans are in front, and stay though they overlap each other.
        take = lambda acc, o: F.when(o["s"]["fixed"] | ~F.exists(acc, lambda t: (o["s"]["start"] < t["stop"]) & (t["start"] < o["s"]["stop"])), F.concat(acc, F.array(bare(o["s"])))).otherwise(acc)
        return F.aggregate(order, F.array().cast(kind), take)

    def cut(run: Column) -> Column:
        def with_reach(reach: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(run) - 1), lambda i: (i == 0) | (F.get(run, i)["start"] >= F.get(reach, i - 1)))

            def with_heads(hs: Column) -> Column:
                part = lambda h, k: F.slice(run, h + 1, F.coalesce(F.get(hs, k + 1), F.size(run)) - h)
                return F.flatten(F.transform(F.transform(hs, part), lambda r: F.when(F.size(r) == 1, F.transform(r, bare)).otherwise(greedy(r))))

            return let(heads, with_heads)

        return let(running(F.transform(run, lambda s: s["stop"]), F.lit(0), lambda x, y: F.greatest(x, y)), with_reach)

    return F.when(F.size(spans) == 0, F.array().cast(kind)).otherwise(F.array_sort(let(F.array_sort(spans), cut)))


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, F.length(digits) - i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        bare = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _margin(span: Column) -> Column:
    model, _ = fitted()
    # Trees on the same features add up to one.
    merged: dict[tuple[int, int, int], list[float]] = {}
    for i, j, k, leaves in model[1]:
        now = merged.setdefault((i, j, k), [0.0] * 4)
        merged[i, j, k] = [p + q for p, q in zip(now, leaves, strict=True)]

    def total(x: Column) -> Column:
        def tree(i: int, j: int, k: int, leaves: list[float]) -> Column:
            a, b, c, d = leaves
            return F.when(x[i], F.when(x[k], F.lit(d)).otherwise(F.lit(c))).otherwise(F.when(x[j], F.lit(b)).otherwise(F.lit(a)))

        return reduce(lambda p, q: p + q, [tree(*key, leaves) for key, leaves in merged.items()], F.lit(model[0]))

    # Each feature is matched once, however many trees test it.
    return let(F.array(*[F.regexp(span[where], F.lit(p)) for where, p in FEATURES.values()]), total)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans``.

    ``spans`` lists ``kind:start:end`` by start, then kind (base kinds first); base spans always stay. Candidates whose margin meets
    the threshold are taken by falling margin (then longer, earlier, then kind) unless they overlap a base span or one that is taken.
    Null and empty texts have no spans. Repeated rows give equal rows. Extra columns are ignored; an empty table gives no rows.
    """
    kinds = [*BASE, *GENERATORS]
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    _, threshold = fitted()

    def ranked(kind: str, s: Column, margin: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), F.lit(kinds.index(kind)).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), F.lit(kind in BASE).alias("fixed"), margin.alias("margin")
        )

    def proposed(kind: str) -> Column:
        spans = found_spans(text, GENERATORS[kind], GUARD.get(kind), True)
        return F.filter(F.transform(spans, lambda s: ranked(kind, s, _margin(s))), lambda s: s["margin"] >= threshold)


    def checked(kind: str) -> Column:
        return F.filter(found_spans(text, BASE[kind], GUARD.get(kind)), lambda s: _valid(kind, s["m"]))

    def as_fixed(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: ranked(kind, s, F.lit(0.0)))

    base = [checked(k).alias(f"_{k}") for k in BASE]
    rows = rows.select("_id", *base, F.concat(*[proposed(k) for k in GENERATORS]).alias("_own"))
    fixed = F.concat(*map(as_fixed, BASE))
    rows = rows.select("_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE], fixed.alias("_base"), "_own")
    rows = rows.withColumn("_all", F.when(F.size("_own") == 0, F.array_sort("_base")).otherwise(F.transform(swept(F.concat("_base", "_own")), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "stop", "kind")], F.lit(False).alias("fixed"), F.lit(0.0).alias("margin")))))
    return rows.select(
        F.col("_id").alias(id_col),
        *[f"n_{k}" for k in BASE],
        F.sha2(_joined(F.array_sort("_base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("_all")).alias("spans"),
        F.size("_all").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text`` with every span replaced by ``[kind]``, one row per input row; a null text stays null."""
    spans = find_pii(docs.select(F.struct(id_col, text_col).alias("_row"), F.col(text_col).alias("_t")), "_row", "_t").select("_row", F.filter(F.split("spans", ","), lambda s: s != "").alias("_s"))
    text = F.col("_row")[text_col]

    def step(acc: Column, s: Column) -> Column:
        part = F.split(s, ":")
        start, stop = part[1].cast("int"), part[2].cast("int")
        piece = F.concat(F.substr(text, acc["at"] + 1, F.greatest(start - acc["at"], F.lit(0))), F.lit("["), part[0], F.lit("]"))
        return F.struct(F.greatest(stop, acc["at"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("_s", begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return spans.select(F.col("_row")[id_col].alias(id_col), done.alias(text_col))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
