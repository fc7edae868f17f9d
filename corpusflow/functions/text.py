"""Text functions as Column builders: tokens, language, keywords, estimates, paths, prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import INDICATORS, KEYWORD_STOPWORDS, STOPWORDS

_LETTERS = "A-Za-zÀ-ÿ0-9_Ѐ-ӿ"
_SINGLE = "一-鿿぀-ゟ゠-ヿ가-힯"
WORD = f"[{_LETTERS}]+(?:[-_][{_LETTERS}]+)*|[{_SINGLE}]"


def strip(c: Column) -> Column:
    """Without white space at both ends (all of it, not only spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case words; a hyphenated one is followed by its parts; CJK characters stand alone."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)
    parts = lambda t: F.filter(F.split(t, "-"), lambda p: (p != "") & (p != t))
    spread = F.flatten(F.transform(found, lambda t: F.when(F.contains(t, F.lit("-")), F.concat(F.array(t), parts(t))).otherwise(F.array(t))))
    return F.when(F.contains(F.coalesce(text, F.lit("")), F.lit("-")), spread).otherwise(found)


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def language(text: Column, toks: Column, default: str | None = None) -> Column:
    """The language by script, telling letters, then telling words; NULL (or ``default``) where nothing tells."""
    low = F.lower(text)
    # each vote is taken once: the largest (votes, place in the order of ties) names the language
    votes = [F.struct(F.size(F.array_intersect(toks, _words(v))).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(INDICATORS.items())]
    by_words = F.get(F.transform(F.filter(F.array(F.array_max(F.array(*votes))), lambda x: x["n"] > 0), lambda x: x["k"]), F.lit(0))
    out = F.when(low.rlike("[Ѐ-ӿ]"), "ru").when(low.rlike("[가-힯ᄀ-ᇿ]"), "ko").when(low.rlike("[぀-ゟ゠-ヿ]"), "ja").when(low.rlike("[一-鿿]"), "zh")
    out = out.when(low.rlike("[ñ¿¡]"), "es").when(low.rlike("[äöüß]"), "de").when(low.rlike("[œæëïù]"), "fr").when(low.rlike("[çãõ]"), "pt")
    return out.otherwise(F.coalesce(by_words, F.when(low.rlike("[áéíóúâêôà]"), "pt"), F.lit(default)))


_LISTED = [f"{k}:{w}" for k, words in STOPWORDS.items() for w in words]


def without_stopwords(toks: Column, lang: Column) -> Column:
    """Tokens that aren't function words of the language; an unknown language keeps all."""
    prefix = F.concat(lang, F.lit(":"))
    return F.when(lang.isNull(), toks).otherwise(F.filter(toks, lambda t: ~F.concat(prefix, t).isin(_LISTED)))


_FIND = re.compile(WORD).findall
_SCRIPTS = [("ru", "Ѐ-ӿ"), ("ko", "가-힯ᄀ-ᇿ"), ("ja", "぀-ゟ゠-ヿ"), ("zh", "一-鿿"), ("es", "ñ¿¡"), ("de", "äöüß"), ("fr", "œæëïù"), ("pt", "çãõ")]
_TELLING = [(k, re.compile(f"[{letters}]").search) for k, letters in _SCRIPTS]
_ACCENTS = re.compile("[áéíóúâêôà]").search
_INDICATORS = {k: frozenset(v) for k, v in INDICATORS.items()}
_FUNCTION_WORDS = {k: frozenset(v) for k, v in STOPWORDS.items()}


def terms(text: str | None) -> tuple[str | None, list[str]]:
    """In Python, for whole texts: ``language`` and ``without_stopwords`` of ``tokens``."""
    if not text:
        return None, []
    low = text.lower()
    plain = text.isascii()
    toks = _FIND(low) if plain else [t.lower() for t in _FIND(text)]
    if "-" in text:
        toks = [p for t in toks for p in ((t, *(x for x in t.split("-") if x and x != t)) if "-" in t else (t,))]
    lang = None
    if not plain:
        seen = "".join(set(low))
        lang = next((k for k, found in _TELLING if found(seen)), None)
    if lang is None:
        distinct = set(toks)
        votes = {k: len(distinct & v) for k, v in _INDICATORS.items()}
        best = max(votes, key=votes.get)  # the first of those that tie
        lang = best if votes[best] else "pt" if not plain and _ACCENTS(seen) else None
    drop = _FUNCTION_WORDS.get(lang)
    return lang, [t for t in toks if t not in drop] if drop else toks


def keyword_tokens(toks: Column) -> Column:
    return F.filter(toks, lambda t: (F.length(t) > 3) & ~t.isin(KEYWORD_STOPWORDS))


def first_sentence(text: Column, most: int = 280) -> Column:
    first = strip(F.element_at(F.split(strip(F.coalesce(text, F.lit(""))), r"(?U)(?<=[.!?])\s+", 2), 1))
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 1), F.lit("…"))).otherwise(first)


def node_id(source: Column, index: Column, text: Column) -> Column:
    """24 hexadecimal digits that name a chunk by source, place and text."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return F.substring(F.sha2(F.concat_ws("", source, nul, index.cast("string"), nul, text), 256), 1, 24)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def unit(a: Column) -> Column:
    """Scaled to length 1 (zero vectors stay)."""
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(a, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(0.0))


def soft_brake(x: Column) -> Column:
    return 0.5 + 0.5 * F.tanh(x - 0.5)


_CJK = "[一-鿿぀-ゟ゠-ヿ가-힯]"


def briefing_tokens(text: Column) -> Column:
    """CJK characters, and half of the other visible ones, rounded up."""
    cjk = F.length(F.regexp_replace(text, f"[^{_CJK[1:-1]}]", ""))
    rest = F.length(F.regexp_replace(text, rf"(?U)\s|{_CJK}", ""))
    return (cjk + F.floor((rest + 1) / 2)).cast("int")


def prompt_tokens(text: Column) -> Column:
    """A model-free estimate: CJK characters, 2.5 letters or digits, or 2 marks a token; at least 1 unless empty."""
    cjk = F.length(F.regexp_replace(text, f"[^{_CJK[1:-1]}]", ""))
    plain = F.regexp_replace(text, _CJK, "")
    letters = F.length(F.regexp_replace(plain, r"[^\p{L}\p{N}_]", ""))
    marks = F.length(F.regexp_replace(plain, r"(?U)[\p{L}\p{N}_\s]", ""))
    n = cjk + F.ceil(letters / 2.5) + F.ceil(marks / 2)
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), n)).cast("int")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def capped(text: Column, most: int = 400) -> Column:
    return F.regexp_replace(F.substring(strip(text), 1, most), r"(?U)\s+$", "")


def title_and_text(title: Column, text: Column) -> Column:
    some = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.concat_ws(" ", some(title), some(text))


def repo_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def patch_files(patch: Column) -> Column:
    """Files that a patch changes, without /dev/null, each once."""
    return F.array_remove(F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^--- a/(.+)$"), F.lit(1))), "/dev/null")


def is_test_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "[ _/.]"), _words(["test", "testing", "tests"]))


def model_patch(answer: Column) -> Column:
    """The patch in an answer: out of its fence, from the first line that begins one; empty without."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:diff|patch)?\s*\n(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(answer)
    a, b = F.locate("diff --git ", body), F.locate("--- a/", body)
    start = F.when((a > 0) & (b > 0), F.least(a, b)).otherwise(F.greatest(a, b))
    return F.when(start > 0, F.substr(body, start)).otherwise("")


def judged_score(answer: Column) -> Column:
    """The score an answer states (JSON field, else the last ``score ... N``), within 1 and 10; 5 where none is."""
    field = F.try_to_number(F.regexp_extract(answer, r'"score"\s*:\s*([0-9]+)', 1), F.lit("999"))
    said = F.regexp_extract_all(answer, F.lit(r"(?i)score[^0-9]{0,12}([0-9]+)"), F.lit(1))
    last = F.when(F.size(said) > 0, F.element_at(said, -1).cast("int"))
    return F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(field.cast("int"), last, F.lit(5))))


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def evidence_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2))


def evidence_hit(chunk: Column, evidence: Column, jaccard: float = 0.15, contained: float = 0.5) -> Column:
    """Whether two token sets overlap enough, by union or by the evidence's own size."""
    met, all_ = F.size(F.array_intersect(chunk, evidence)), F.size(F.array_union(chunk, evidence))
    some = (F.size(chunk) > 0) & (F.size(evidence) > 0)
    return some & ((met >= jaccard * all_) | (met >= contained * F.size(evidence)))


def candidate_pool(k: Column, long_docs: Column, explicit: Column | None = None) -> Column:
    own = F.when(long_docs, F.greatest(F.lit(200), 10 * k)).otherwise(F.greatest(F.lit(50), 5 * k))
    return own if explicit is None else F.coalesce(F.greatest(F.lit(1), explicit), own)


def is_revision(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{40}$"), F.lit(False))


def slot(term: Column, slots: int = 384) -> Column:
    """The place of a term in a hashed vector."""
    return (F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("bigint") % slots).cast("int")
