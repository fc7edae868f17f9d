"""SQL fragments that the oracle queries share (DuckDB)."""

from __future__ import annotations

from ..functions.lexicon import INDICATORS, KEYWORD_STOPWORDS, STOPWORDS
from ..functions.text import WORD


def words(ws: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"


#: Tokens of column text.
TOKENS = (
    f"flatten(list_transform(regexp_extract_all(text, '{WORD}'), lambda t: CASE WHEN contains(t, '-') "
    "THEN list_concat([lower(t)], list_filter(string_split(lower(t), '-'), lambda p: p <> '' AND p <> lower(t))) ELSE [lower(t)] END))"
)
_VOTES = {k: f"len(list_intersect(list_distinct(toks), {words(v)}))" for k, v in INDICATORS.items()}
#: Language from text and toks.
LANGUAGE = (
    "CASE WHEN regexp_matches(lower(text), '[Ѐ-ӿ]') THEN 'ru' WHEN regexp_matches(lower(text), '[가-힯ᄀ-ᇿ]') THEN 'ko' "
    "WHEN regexp_matches(lower(text), '[぀-ゟ゠-ヿ]') THEN 'ja' WHEN regexp_matches(lower(text), '[一-鿿]') THEN 'zh' "
    "WHEN regexp_matches(lower(text), '[ñ¿¡]') THEN 'es' WHEN regexp_matches(lower(text), '[äöüß]') THEN 'de' "
    "WHEN regexp_matches(lower(text), '[œæëïù]') THEN 'fr' WHEN regexp_matches(lower(text), '[çãõ]') THEN 'pt' "
    + " ".join(f"WHEN {v} > 0 AND {v} >= greatest({', '.join(_VOTES.values())}) THEN '{k}'" for k, v in _VOTES.items())
    + " WHEN regexp_matches(lower(text), '[áéíóúâêôà]') THEN 'pt' END"
)
#: toks without the function words of lang.
KEPT = "CASE lang " + " ".join(f"WHEN '{k}' THEN list_filter(toks, lambda t: NOT list_contains({words(v)}, t))" for k, v in STOPWORDS.items()) + " ELSE toks END"
KEYWORDS = f"list_filter(toks, lambda t: length(t) > 3 AND NOT list_contains({words(KEYWORD_STOPWORDS)}, t))"
SLOT = "(('0x' || substr(md5(term), 1, 8))::UBIGINT % 384)::INT"


def lists(name: str, source: str, key: str) -> str:
    """CTEs <name>_t (key, text, toks), <name> (key, lang, terms)."""
    return (
        f"{name}_t AS MATERIALIZED (SELECT {key}, text, {TOKENS} AS toks FROM {source}), "
        f"{name}_l AS MATERIALIZED (SELECT {key}, toks, text, {LANGUAGE} AS lang FROM {name}_t), "
        f"{name} AS MATERIALIZED (SELECT {key}, lang, {KEPT} AS terms FROM {name}_l)"
    )


def index_of(source: str) -> str:
    """The lexical index of a source (id, text): d (id, lang, terms), post (id, dl, term, tf), tstat (term, df, idf), cs (n, avgdl)."""
    return lists("d", source, "id") + _INDEX


_INDEX = (
    ", cs AS MATERIALIZED (SELECT count(*) AS n, avg(greatest(1, len(terms))) AS avgdl FROM d), "
    "post AS MATERIALIZED (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, greatest(1, len(terms)) AS dl, unnest(terms) AS term FROM d) GROUP BY ALL), "
    "tstat AS MATERIALIZED (SELECT term, count(*) AS df, ln((max(n) - count(*) + 0.5) / (count(*) + 0.5) + 1.0) AS idf FROM post, cs GROUP BY term)"
)
INDEX = index_of("(SELECT doc_id AS id, text FROM documents)")
INDEX_OF_TURNS = index_of("(SELECT conv_id * 100000 + turn AS id, text FROM conversations)")
QUERIES = lists("q", "(SELECT item_id AS qid, text FROM benchmark)", "qid") + ", qt AS MATERIALIZED (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(terms) AS term FROM q) GROUP BY ALL)"


def bm25(k: int, qt: str = "qt", name: str = "bm") -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ("
        f"SELECT qid, id, round(sum(times * idf * (tf * 2.2 / (tf + 1.2 * (1.0 - 0.75 + 0.75 * dl / avgdl)))), 6) AS score "
        f"FROM {qt} JOIN tstat USING (term) JOIN post USING (term), cs GROUP BY qid, id)) WHERE rank <= {k})"
    )


def dense(k: int) -> str:
    return (
        f"ds AS MATERIALIZED (SELECT id, {SLOT} AS slot, sum(tf * idf) AS w FROM post JOIN tstat USING (term) GROUP BY ALL), "
        "dn AS (SELECT id, sqrt(sum(w * w)) AS n FROM ds GROUP BY id), "
        f"qs AS MATERIALIZED (SELECT qid, {SLOT} AS slot, sum(times * idf) AS w FROM qt JOIN tstat USING (term) GROUP BY ALL), "
        "qn AS (SELECT qid, sqrt(sum(w * w)) AS n FROM qs GROUP BY qid), "
        "dense_all AS (SELECT x.qid, x.id, round(coalesce(dot / (dn.n * qn.n), 0), 6) AS score FROM (SELECT qn.qid, dn.id FROM qn, dn) x "
        "LEFT JOIN (SELECT qid, id, sum(ds.w * qs.w) AS dot FROM ds JOIN qs USING (slot) GROUP BY ALL) y ON x.qid = y.qid AND x.id = y.id "
        "JOIN dn ON dn.id = x.id JOIN qn ON qn.qid = x.qid), "
        f"dn_top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dense_all) WHERE rank <= {k} AND (score >= 0.05 OR rank = 1))"
    )


HYBRID = (
    "hy AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ("
    "SELECT qid, id, round(sum(part), 8) AS score FROM ("
    "SELECT qid, id, 0.15::DOUBLE / (60 + rank) AS part FROM bm WHERE (qid, id) IN (SELECT (qid, id) FROM dn_top) "
    "UNION ALL SELECT qid, id, 0.85::DOUBLE / (60 + rank) FROM dn_top) GROUP BY qid, id)) WHERE rank <= 10)"
)
FLAT = f"{INDEX}, {QUERIES}, {bm25(50)}, {dense(50)}, {HYBRID}"
QRELS = "rel AS MATERIALIZED (SELECT DISTINCT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
