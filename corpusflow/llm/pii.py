"""9. Personal data: candidate spans, boosted trees, calibrated thresholds.

The base patterns (email, ip, card, phone) are certain.  High-recall generators propose further, overlapping spans:
spelled-out addresses, digit groups without a country code, all runs of 9 to 19 digits, digit groups of any size with 13 to 19
digits, dotted numbers.  Boosted trees score each by its format (digits, groups, separators, checksum, letters) and context
(words just before, what touches it).  A candidate is added where its calibrated score reaches the threshold of its kind, which
is set to a precision on held-out findings, and where it overlaps no span that stands before it.

The trees learn labelled findings.  Of the table, at most ``SAMPLE`` different texts teach (those with the smallest hashes):
each base finding there, written in a form that the base patterns don't know and left in its context, is personal data;
digit runs and groups of a card's length that fail the checksum are none.  Generated findings and look-alikes join them, half
in contexts of the table.  A fourth of the texts, and of the generated findings, is held out for calibration and thresholds.

All of it is DataFrame functions: a match's place comes from the lengths of the pieces between matches, the trees are CASE
expressions inside higher-order functions (a threshold on the calibrated score is one on the margin, as calibration is
monotone).  A row is worked on alone; only the sample that teaches is shuffled.

Defined results: null and empty texts have no spans; very long texts are searched whole; places are code points, end
exclusive; repeated rows each get their own result; an empty table gives no rows (the trees then know generated findings
only); other columns pass through, those with the operator's names are replaced.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, gbt

KINDS = ("email", "ip", "card", "phone")
_L = "[A-Za-z0-9._%+-]"
#: A local part begins where its run of characters begins, or right after the match before: no start is tried twice.
EMAIL = rf"(?:\G|(?<!{_L})){_L}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of further candidates: kind and pattern (Java and Python read both alike).
_AT, _DOT = (rf"\x20?[\[({{{{]\x20?(?:{x}|{x.upper()})\x20?[\])}}}}]\x20?".replace("{{", "{").replace("}}", "}") for x in ("at", "dot"))
GENERATORS = (
    ("email", rf"(?<!{_L}){_L}++{_AT}[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++"),
    ("phone", r"(?<![0-9A-Za-z.+(-])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{2,4}[\x20.-][0-9]{2,5}(?:[\x20.-][0-9]{2,5})?(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z.+-])[0-9]{9,12}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{2,18}+(?:[./_\x20-]{1,2}[0-9]{2,18}+)*+(?![0-9A-Za-z])"),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]++(?:\x20?[\[({]\x20?\.\x20?[\])}]\x20?[0-9]++){3}(?![0-9A-Za-z.])"),
)
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|address)",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|cell|dial|whatsapp|sms)",
    "card": r"(?i)(?:card|visa|master|amex|payment|debit|credit)",
    "ip": r"(?i)(?:\bip\b|host|server|address|login)",
    "none": r"(?i)(?:order|invoice|isbn|version|page|section|serial|part|model|sku|date|total|room|no\.|#)",
}
CONTEXT = 24
#: Different texts of the table that teach, at most, and their findings, at most.
SAMPLE, FINDINGS = 20_000, 4000
FEATURES = ("length", "digits", "groups", "first", "second", "last", "luhn", "octets", "brackets", "dots", "cue", "against", "colon", "kind")


def spans_of(text: Column, pattern: str, needs: str) -> Column:
    """All matches from left to right as structs (start, text); ``needs`` is a cheap test that each match implies."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    none = F.lit(None).cast("array<struct<start:int,text:string>>")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def step(acc, x):
        at = acc["at"] + F.length(x["1"])
        one = F.struct(at.cast("int").alias("start"), x["0"].alias("text"))
        return F.struct((at + F.length(x["0"])).cast("int").alias("at"), F.array_append(acc["out"], one).alias("out"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("0"), b.alias("1")))
    return F.when(text.rlike(needs), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.coalesce(none, F.array().cast("array<struct<start:int,text:string>>")))


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the checksum: from the right, every second one doubled."""
    each = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(each, lambda d, i: (lambda v: F.when(i % 2 == 0, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0)))(F.when(d == "", 0).otherwise(d.cast("int")))),
        F.lit(0),
        lambda a, v: a + v,
    )
    return total % 10 == 0


def octets(c: Column) -> Column:
    """Four parts of at most 255."""
    return F.forall(F.split(c, r"\."), lambda p: (lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255")))(F.ltrim(p, F.lit("0"))))


def base_spans(text: Column) -> dict[str, Column]:
    n = lambda x: F.length(digits_of(x["text"]))
    return {
        "email": spans_of(text, EMAIL, "@"),
        "ip": F.filter(spans_of(text, IP, r"[0-9]\.[0-9]"), lambda x: octets(x["text"])),
        "card": F.filter(F.filter(spans_of(text, CARD, "[0-9][0-9 -]{11}"), lambda x: n(x).between(13, 19)), lambda x: luhn(digits_of(x["text"]))),
        "phone": F.filter(spans_of(text, PHONE, r"\+[0-9]"), lambda x: n(x).between(9, 15)),
    }


def _feature_columns(kind: str, span: Column, before: Column) -> list[Column]:
    one = lambda c: F.when(c, 1).otherwise(0)
    digits = digits_of(span)
    groups = F.split(F.regexp_replace(span, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+")
    return [
        F.length(span),
        F.length(digits),
        F.size(groups),
        F.length(groups[0]),
        F.coalesce(F.length(F.get(groups, F.lit(1))), F.lit(0)),
        F.length(F.element_at(groups, -1)),
        one(luhn(digits)),
        one(F.forall(groups, lambda g: (F.length(g) < 3) | ((F.length(g) == 3) & (g <= "255")))),
        one(span.rlike(r"[\[({]")),
        F.length(F.regexp_replace(span, r"[^.]", "")),
        one(before.rlike(CUES[kind])),
        one(before.rlike(CUES["none"])),
        one(before.rlike(r"[:=]\x20?$")),
        F.lit(KINDS.index(kind)),
    ]


def _features(kind: str, span: str, before: str) -> list[float]:
    """The same features in Python, for fitting."""
    digits = re.sub("[^0-9]", "", span)
    total = sum((int(d) if i % 2 == 0 else int(d) * 2 - (9 if int(d) > 4 else 0)) for i, d in enumerate(reversed(digits)))
    groups = re.split("[^0-9]+", re.sub("^[^0-9]+|[^0-9]+$", "", span))
    return [
        len(span),
        len(digits),
        len(groups),
        len(groups[0]),
        len(groups[1]) if len(groups) > 1 else 0,
        len(groups[-1]),
        total % 10 == 0,
        all(len(g) < 3 or len(g) == 3 and g <= "255" for g in groups),
        bool(re.search(r"[\[({]", span)),
        span.count("."),
        bool(re.search(CUES[kind], before)),
        bool(re.search(CUES["none"], before)),
        bool(re.search(r"[:=]\x20?$", before)),
        KINDS.index(kind),
    ]


Finding = tuple[str, str, str, int]


def checked(rng: random.Random, k: int) -> str:
    """Digits that pass the checksum."""
    d = "".join(rng.choices("0123456789", k=k - 1))
    total = sum((int(c) * 2 - (9 if int(c) > 4 else 0)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(d)))
    return d + str(-total % 10)


def rewritten(rng: random.Random, kind: str, span: str) -> str:
    """A base finding in a form that the base patterns don't know."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        o, c = rng.choice(["()", "[]", "{}"])
        name, host = span.split("@", 1)
        dot = rng.choice([".", f" {o}dot{c} ", f"{o}dot{c}"])
        return f"{name}{rng.choice(['', ' '])}{o}at{c}{rng.choice(['', ' '])}{host.replace('.', dot)}"
    if kind == "phone":
        d = digits[-10:]
        return rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"0{d}"])
    if kind == "card":
        sep = rng.choice([".", "_", "/", "--"])
        cut = (4, 10) if len(digits) == 15 else (4, 8, 12, 16)
        return sep.join(digits[a:b] for a, b in zip((0, *cut), (*cut, None)) if digits[a:b])  # noqa: B905
    return span.replace(".", rng.choice(["[.]", "(.)", "{.}", " [.] "]))


def labelled(n: int = 4000, seed: int = 9, contexts: list[str] | None = None) -> list[Finding]:
    """Generated findings (kind, span, text before, label), half of them look-alikes; half in ``contexts`` where there are any."""
    rng = random.Random(seed)
    dig = lambda k: "".join(rng.choices("0123456789", k=k))
    name = lambda: rng.choice(["ann", "j.doe", "info", "li.wei", "maria_s", "k99"])
    yes = {"email": ["mail me at ", "contact: ", "e-mail: ", "reach me "], "phone": ["call me on ", "phone: ", "tel. ", "mobile ", "fax: "], "card": ["card number ", "visa: ", "pay with card "], "ip": ["login from ip ", "server ", "host: "]}
    no = ["order ", "invoice no. ", "ISBN ", "version ", "page ", "section ", "serial: ", "part ", "the total of ", "and then ", "between ", "in ", "model "]
    out = []
    for _ in range(n):
        kind, real = rng.choice(KINDS), rng.random() < 0.5
        cue = rng.choice(yes[kind] if real else no)
        before = rng.choice(contexts) if contexts and rng.random() < 0.5 else cue
        if real:
            span = {"email": f"{name()}@{rng.choice(['mail', 'web', 'corp'])}.{rng.choice(['com', 'org', 'net', 'co.uk'])}", "phone": "+1" + dig(10), "card": checked(rng, rng.choice([15, 16, 16, 16])), "ip": ".".join(str(rng.randrange(256)) for _ in range(4))}[kind]
            s = rewritten(rng, kind, span)
            if kind == "phone" and before is cue and rng.random() < 0.3:
                s = rng.choice([f"{dig(2)} {dig(4)} {dig(4)}", dig(10)])
        elif kind == "email":
            o, c = rng.choice(["()", "[]", "{}"])
            s = f"{rng.choice(['look', 'x', 'f', '3'])}{o}at{c}{rng.choice(['0', 'k', 'top'])}.{rng.choice(['0', 'i', 'x1'])}"
        elif kind == "phone":
            s = rng.choice([f"{dig(3)}-{dig(2)}-{dig(4)}", f"{dig(2)}.{dig(2)}.{dig(4)}", f"{dig(4)}-{dig(2)}-{dig(2)}", f"0{dig(9)}", f"{dig(3)} {dig(3)} {dig(3)}", dig(9), dig(10), dig(12)])
        elif kind == "card":
            k = dig(rng.choice([13, 15, 16, 16, 18]))
            sep = rng.choice([".", "_", "/", "--", " ", "-", ""])
            s = sep.join(k[i : i + 4] for i in range(0, len(k), 4))
        else:
            s = rng.choice(["[.]", "(.)"]).join(str(rng.randrange(1000)) for _ in range(4))
        out.append((kind, s, before, int(real)))
    return out


def findings(df: DataFrame, text: str = "text", most: int = SAMPLE) -> list[tuple[str, str, str, int, bool]]:
    """At most ``FINDINGS`` findings (kind, span, before, label, held) in ``most`` different texts of the table."""
    own = df.select(F.col(f"`{text}`").cast("string").alias("t")).filter("t is not null")
    hashed = own.select("t", F.xxhash64(F.lit(9), "t").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return []
    # copies of a text are one: what is kept is bounded however often it occurs
    sample = hashed.filter(F.col("h") <= last).groupBy("h").agg(F.first("t").alias("t"))
    t = F.col("t")
    card = next(p for k, p in GENERATORS if k == "card")
    wrong = F.filter(spans_of(t, card, "[0-9]{2}"), lambda x: F.length(digits_of(x["text"])).between(13, 19) & ~luhn(digits_of(x["text"])))
    before = lambda x: F.substring(t, F.greatest(x["start"] + 1 - CONTEXT, F.lit(1)), F.least(F.lit(CONTEXT), x["start"]))
    shape = lambda k, y: lambda x: F.struct(F.lit(k).alias("kind"), x["text"].alias("span"), before(x).alias("before"), F.lit(y).alias("label"))
    rows = F.concat(*[F.transform(c, shape(k, 1)) for k, c in base_spans(t).items()], F.transform(wrong, shape("card", 0)))
    found = sample.select(F.explode(rows).alias("x"), (F.pmod("h", F.lit(4)) == 0).alias("held")).select("x.*", "held").distinct()
    return [tuple(r) for r in found.orderBy(F.xxhash64("span", "before"), "span", "before").limit(FINDINGS).collect()]


class Model:
    """Trees, and for each kind the least calibrated score (and the margin where it begins) that reaches ``precision``."""

    def __init__(self, rows: list[tuple[str, str, str, int, bool]], precision: float = 0.98):
        x = np.asarray([_features(k, s, b) for k, s, b, _, _ in rows], float)
        y, held = np.asarray([r[3] for r in rows], float), np.asarray([r[4] for r in rows], bool)
        self.trees = gbt.fit(x[~held], y[~held], rounds=25, depth=3, rate=0.3)
        self.trees.calibrate(x[held], y[held])
        score, margin = self.trees.predict(x[held]), self.trees.margin(x[held])
        self.least, self.margins = [], []
        for k in range(len(KINDS)):
            mine = x[held][:, -1] == k
            order = np.argsort(-score[mine], kind="stable")
            s, good = score[mine][order], np.cumsum(y[held][mine][order]) / np.arange(1, mine.sum() + 1)
            last = np.append(s[1:] < s[:-1], True) if len(s) else np.zeros(0, bool)  # equal scores pass together
            enough = np.flatnonzero((good >= precision) & (s >= 0.5) & last)
            self.least.append(float(s[enough[-1]]) if len(enough) else float("inf"))
            passed = margin[mine][score[mine] >= self.least[-1]]
            self.margins.append(float(passed.min()) if len(passed) else float("inf"))

    def accepts(self, kind: str, span: str, before: str) -> bool:
        return self.trees.margin(np.asarray([_features(kind, span, before)], float))[0] >= self.margins[KINDS.index(kind)]


@lru_cache(maxsize=1)
def generated_model() -> Model:
    return Model([(*r, i % 4 == 0) for i, r in enumerate(labelled())])


def train(df: DataFrame, text: str = "text", most: int = SAMPLE) -> Model:
    """A model for a table: its own findings and generated ones."""
    rows = findings(df, text, most)
    if not rows:
        return generated_model()
    rng = random.Random(99)
    own = [(k, rewritten(rng, k, s) if y else s, b, y, h) for k, s, b, y, h in rows]
    contexts = {h: [b for _, _, b, _, held in rows if held == h] for h in (False, True)}
    made = [(*r, False) for r in labelled(3000, 9, contexts[False])] + [(*r, True) for r in labelled(1000, 19, contexts[True])]
    return Model(own + made)


def find(df: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """Add ``base`` and ``spans``: arrays of (kind, start, end) by kind as listed and start; spans holds base."""
    model = model or train(df, text)
    trees, cuts = model.trees, model.margins
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("base", "spans")]
    step = df.select(*keep, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))
    t = F.col("__t")
    shape = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end"))
    spans = "array<struct<kind:string,start:int,end:int>>"
    step = step.select("*", *[c.alias(f"__{k}") for k, c in base_spans(t).items()])
    step = step.select("*", F.concat(*[F.transform(f"__{k}", shape(k)) for k in KINDS]).cast(spans).alias("base"))

    def passes(kind):
        def score(x):
            before = F.substring(t, F.greatest(x["start"] + 1 - CONTEXT, F.lit(1)), F.least(F.lit(CONTEXT), x["start"]))
            return trees.column(_feature_columns(kind, x["text"], before)) >= F.lit(cuts[KINDS.index(kind)])

        return score

    raw = []
    for kind, pattern in GENERATORS:
        needs = r"(?i)[\[({]\x20?at\x20?[\])}]" if kind == "email" else r"[0-9]{2}" if kind != "ip" else r"[0-9]\x20?[\[({]"

        found = spans_of(t, pattern, needs)
        if kind == "card":
            found = F.filter(found, lambda x: F.length(digits_of(x["text"])).between(13, 19))
        raw.append(F.transform(F.filter(found, passes(kind)), shape(kind)))
    step = step.select("*", F.concat(*raw).cast(spans).alias("__more"))
    apart = lambda a, b: (a["end"] <= b["start"]) | (b["end"] <= a["start"])
    # candidates in order; each stays if it overlaps nothing that stands
    chosen = F.aggregate(
        F.array_sort("__more", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])),
        F.col("base"),
        lambda acc, x: F.when(F.forall(acc, lambda b: apart(b, x)), F.array_append(acc, x)).otherwise(acc),
    )
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).cast("int")
    ordered = F.array_sort(chosen, lambda a, b: F.when(rank(a) != rank(b), rank(a) - rank(b)).otherwise(a["start"] - b["start"]))
    return step.select(*keep, "base", F.when(F.size("__more") == 0, F.col("base")).otherwise(ordered).cast(spans).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping ones the first by start counts."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    by = F.array_sort(spans, lambda a, b: a["start"] - b["start"])

    def step(acc, x):
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), kept.alias("out"))).otherwise(acc)

    return F.aggregate(by, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.narrow(common.table(spark, sf_dir, "documents"), ["doc_id", "text"]))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op9_pii": op9_pii}
