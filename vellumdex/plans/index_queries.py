"""Queries over the inverted index of `documents`, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumdex.functions.codec import vb_hex, vb_numbers
from vellumdex.functions.text import words
from vellumdex.operators import blocks, index, search, snippets
from vellumdex.session import new_path, removed_at_exit
from vellumdex.sources.corpus import byte_prefix, from_pages, from_table
from vellumdex.sources.tables import table

QUERY = "the river path of the zzzunknown"
LIST_TERMS = ["the", "of", "und", "pour", "river"]
MANY = [(1, "The green door"), (2, "das alte Verzeichnis"), (3, "river RIVER zzzunknown"), (4, "zzzunknown"), (5, None)]
SEEK = 500
SPAN = 256
#: Its first word has 16 letters, its second 14, as many as a lookup by 14 letters reads.
CUT_QUERY = "pappersarkivetes pappersarkivet river"

_BUILT: dict[tuple[str, str, str], index.SearchIndex] = {}


def corpus(spark, sf):
    return from_table(table(spark, sf, "documents"))


def built(spark, sf, kind="table", source=None):
    """The index of a folder's documents, built once a session, as queries follow a build."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _BUILT:
        source = source or {"table": corpus, "pages": lambda spark, sf: from_pages(table(spark, sf, "documents"))}[kind]
        folder = new_path(spark, f"index-{kind}")
        _BUILT[key] = index.SearchIndex.build(source(spark, sf), folder)
        removed_at_exit(spark, folder)
    return _BUILT[key]


def tokens_per_doc(spark, sf):
    return index.tokens(corpus(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"))


def long_token_drop_count(spark, sf):
    every = corpus(spark, sf).select(F.explode(words(F.col("body"))).alias("word"))
    return every.agg(F.count_if(F.length("word") > 15).alias("n_dropped"))


def postings(spark, sf):
    return index.postings_of(corpus(spark, sf))


def lexicon_df_cf(spark, sf):
    return index.lexicon_of(index.postings_of(corpus(spark, sf)))


def lexicon_range(spark, sf):
    return built(spark, sf).lexicon.where(F.col("term").between("m", "p")).select("term", "df").orderBy("term")


def term_ids_first_seen(spark, sf):
    return index.term_ids(corpus(spark, sf))


def doc_table(spark, sf):
    return index.doc_table(corpus(spark, sf)).select("doc_id", "doc_size")


def corpus_stats(spark, sf):
    return index.corpus_stats(corpus(spark, sf)).select("n_docs", F.round("avg_doc_size", 6).alias("avg_doc_size"))


def build_summary(spark, sf):
    return index.summary(built(spark, sf))


def _scores(spark, sf, text, mode):
    return search.matches(built(spark, sf), text, mode).select("doc_id", F.round("bm25", 6).alias("bm25"))


def bm25_single_term(spark, sf):
    return _scores(spark, sf, "lexicon", search.ANY)


def bm25_all_scores(spark, sf):
    return _scores(spark, sf, QUERY, search.ANY)


def bm25_negative_idf(spark, sf):
    return _scores(spark, sf, "the of", search.ALL)


def bm25_repeated_term(spark, sf):
    return _scores(spark, sf, "river path river", search.ANY)


def _top(spark, sf, text, mode):
    return search.rank(built(spark, sf), text, mode, 10)


def bm25_or_top10(spark, sf):
    return _top(spark, sf, QUERY, search.ANY)


def bm25_and_top10(spark, sf):
    return _top(spark, sf, "the river path", search.ALL)


def unknown_terms_ignored(spark, sf):
    return _top(spark, sf, "the river path zzzunknown", search.ALL)


def and_match_count(spark, sf):
    return search.matches(built(spark, sf), "the river path", search.ALL).agg(F.count(F.lit(1)).alias("n"))


def or_match_count(spark, sf):
    return search.matches(built(spark, sf), "the river path", search.ANY).agg(F.count(F.lit(1)).alias("n"))


def batch_queries_topk(spark, sf):
    return search.search_many(built(spark, sf), spark.createDataFrame(MANY, "query_id int, text string"), search.ANY, 5)


def batch_queries_all_words(spark, sf):
    return search.search_many(built(spark, sf), spark.createDataFrame(MANY, "query_id int, text string"), search.ALL, 5)


def list_lengths_order(spark, sf):
    return search.ordered_lists(built(spark, sf), LIST_TERMS)


def next_geq(spark, sf):
    return search.next_documents(built(spark, sf), LIST_TERMS, SEEK)


def posting_gaps(spark, sf):
    return blocks.posting_gaps(built(spark, sf).postings)


def posting_blocks(spark, sf):
    return blocks.posting_blocks(built(spark, sf).postings)


def list_bytes_offsets(spark, sf):
    return blocks.list_offsets(blocks.posting_blocks(built(spark, sf).postings))


def index_size_summary(spark, sf):
    return blocks.index_sizes(blocks.posting_blocks(built(spark, sf).postings))


def varbyte_hex(spark, sf):
    return built(spark, sf).postings.select("freq").distinct().select("freq", vb_hex(F.col("freq")).alias("bytes"))


def varbyte_decoded(spark, sf):
    """Gaps of each block encoded, laid one after another and decoded again."""
    laid = blocks.posting_gaps(built(spark, sf).postings).groupBy("term", F.floor(F.col("place") / blocks.BLOCK).alias("block_no"))
    laid = laid.agg(F.sort_array(F.collect_list(F.struct("place", vb_hex(F.col("gap")).alias("bytes")))).alias("gaps"))  # a block's 128 at most
    digits = F.array_join(F.transform("gaps", lambda g: g["bytes"]), "")
    return laid.select("term", "block_no", F.posexplode(vb_numbers(digits)).alias("nth", "gap"))


def nested_lists(spark, sf):
    """Lists nested in slices, each as text."""
    lists = index.posting_lists(built(spark, sf).postings, SPAN)
    return lists.select("term", "slice", F.array_join(F.transform("list", lambda x: F.concat_ws(":", x["doc_id"], x["freq"])), " ").alias("list"))


def observed_without_last_term(spark, sf):
    return index.without_last_term(built(spark, sf).postings).select("term", "doc_id", "freq")


def observed_key14_top10(spark, sf):
    return search.rank(built(spark, sf), CUT_QUERY, search.ANY, 10, key_length=14)


def limits_and_modes(spark, sf):
    """Which limits and modes a query accepts."""

    def accepted(limit: int, mode: int) -> bool:
        try:
            search.rank(built(spark, sf), "river", mode, limit)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(n, m, accepted(n, m)) for n in (-1, 0, 1, 10) for m in (-1, 0, 1, 2)], "result_limit int, mode int, accepted boolean")


def snippet_windows(spark, sf):
    return snippets.windows(corpus(spark, sf), QUERY).select("doc_id", "start", "score")


def best_snippet(spark, sf):
    return snippets.snippets(_top(spark, sf, QUERY, search.ANY), corpus(spark, sf), QUERY)


def observed_last_snippet(spark, sf):
    return snippets.snippets(_top(spark, sf, QUERY, search.ANY), corpus(spark, sf), QUERY, last_positive=True)


def prefix_sample(spark, sf):
    return byte_prefix(corpus(spark, sf), 3)


def run_merge(spark, sf):
    docs = corpus(spark, sf)
    return index.merge_postings(index.postings_of(docs.where("doc_size < 600")), index.postings_of(docs.where("doc_size >= 600")))


def posting_dump(spark, sf):
    return search.posting_dump(built(spark, sf, "pages"), "river")


def doc_fetch(spark, sf):
    return search.fetch(_top(spark, sf, QUERY, search.ANY), corpus(spark, sf), 100)


def pages_or_top10(spark, sf):
    return search.search(built(spark, sf, "pages"), QUERY, search.ANY, 10)


def observed_tail_tokens(spark, sf):
    return index.tokens(corpus(spark, sf), keep_tail=False).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"))


def observed_key14_lexicon(spark, sf):
    return index.prefix_lexicon(built(spark, sf).lexicon)


QUERIES = {
    f.__name__: f
    for f in (
        tokens_per_doc, long_token_drop_count, postings, lexicon_df_cf, lexicon_range, term_ids_first_seen, doc_table, corpus_stats, build_summary,
        bm25_single_term, bm25_all_scores, bm25_or_top10, bm25_and_top10, and_match_count, or_match_count, unknown_terms_ignored, bm25_repeated_term,
        bm25_negative_idf, batch_queries_topk, batch_queries_all_words, list_lengths_order, next_geq, posting_gaps, posting_blocks, list_bytes_offsets,
        index_size_summary, varbyte_hex, snippet_windows, best_snippet, prefix_sample, run_merge, posting_dump, doc_fetch, pages_or_top10,
        observed_tail_tokens, observed_key14_lexicon, observed_last_snippet, varbyte_decoded, nested_lists, observed_without_last_term,
        observed_key14_top10, limits_and_modes,
    )
}

BASE = """WITH texts AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
  lists AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws FROM texts),
  found AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM lists),
  tokens AS (SELECT doc_id, pos, lower(w) AS term FROM found WHERE length(w) <= 15),
  postings AS (SELECT term, doc_id, count(*) AS freq FROM tokens GROUP BY ALL),
  lex AS (SELECT term, count(*) AS df, CAST(sum(freq) AS BIGINT) AS cf FROM postings GROUP BY term),
  docs AS (SELECT doc_id, strlen(text) AS doc_size FROM texts),
  stats AS (SELECT count(*) AS n_docs, sum(doc_size) / CAST(count(*) - 1 AS DOUBLE) AS avg_doc_size FROM docs)"""


def _q(text: str) -> str:
    """Typed words of a query as a CTE."""
    counts: dict[str, int] = {}
    for w in text.lower().split():
        counts[w] = counts.get(w, 0) + 1
    return "typed AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', {n})" for w, n in counts.items()) + ") AS v(term, repeats))"


FORMULA = """log2((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * 2.2::DOUBLE * freq
    / (1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_size / avg_doc_size) + freq)"""


def _scored(text: str, all_words: bool = False) -> str:
    having = "HAVING count(*) = (SELECT count(*) FROM typed JOIN lex USING (term))" if all_words else ""
    return f"""{BASE}, {_q(text)}, hits AS (
      SELECT doc_id, round(sum(repeats * ({FORMULA})), 6) AS bm25 FROM postings JOIN typed USING (term) JOIN lex USING (term) JOIN docs USING (doc_id), stats
      GROUP BY doc_id {having})"""


def _first(text: str, all_words: bool = False, n: int = 10) -> str:
    return f"""{_scored(text, all_words)}, ranked AS (
      SELECT CAST(row_number() OVER (ORDER BY bm25 DESC, doc_id) AS INT) AS rank, doc_id, bm25 FROM hits QUALIFY rank <= {n})"""


def _batch(all_words: bool) -> str:
    rows = ", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in MANY)
    needed = "HAVING count(*) = any_value(needed)" if all_words else ""
    return f"""{BASE}, asked AS (SELECT * FROM (VALUES {rows}) AS v(query_id, text)),
      typed AS (SELECT query_id, lower(w) AS term, count(*) AS repeats FROM (SELECT query_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM asked) GROUP BY ALL),
      known AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS needed FROM typed JOIN lex USING (term)),
      hits AS (SELECT query_id, doc_id, round(sum(repeats * ({FORMULA})), 6) AS bm25 FROM postings JOIN known USING (term) JOIN docs USING (doc_id), stats
        GROUP BY query_id, doc_id {needed})
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS INT) AS rank, doc_id, bm25 FROM hits QUALIFY rank <= 5"""


def _vb(n: str) -> str:
    return f"(CASE WHEN {n} < 128 THEN 1 WHEN {n} < 16384 THEN 2 WHEN {n} < 2097152 THEN 3 WHEN {n} < 268435456 THEN 4 ELSE 5 END)"


GAPS = f"""{BASE}, gaps AS (SELECT term, doc_id, freq, doc_id - coalesce(lag(doc_id) OVER w, 0) AS gap, row_number() OVER w - 1 AS place
  FROM postings WINDOW w AS (PARTITION BY term ORDER BY doc_id))"""
BLOCKS = f"""{GAPS}, blocks AS (SELECT term, place // 128 AS block_no, count(*) AS n, max(doc_id) AS last_doc,
  CAST(sum({_vb("gap")} + {_vb("freq")}) AS BIGINT) AS block_bytes FROM gaps GROUP BY ALL)"""
BYTES = f"""{BLOCKS}, sums AS (SELECT term, CAST(sum(n) AS BIGINT) AS df, sum({_vb("last_doc")}) AS c1, sum({_vb("block_bytes")}) AS c2, sum(block_bytes) AS b
    FROM blocks GROUP BY term),
  bytes AS (SELECT term, df, CAST({_vb("df")} + {_vb("c1")} + {_vb("c2")} + c1 + c2 + b AS BIGINT) AS list_bytes FROM sums)"""


def _windows(text: str) -> str:
    counts = " + ".join(f"len(list_filter(ts, lambda t: t = '{w}')) * {text.lower().split().count(w)}" for w in sorted(set(text.lower().split())))
    return f"""cut AS (SELECT doc_id, text, unnest(range(0, length(text) - 512, 512)) AS start FROM texts),
      shown AS (SELECT doc_id, start, substring(text, start + 1, 512) AS win FROM cut),
      listed AS (SELECT doc_id, start, win, list_transform(list_filter(regexp_extract_all(regexp_replace(win, '[A-Za-z0-9]+$', ''), '[A-Za-z0-9]+'),
        lambda w: length(w) <= 15), lambda w: lower(w)) AS ts FROM shown),
      windows AS (SELECT doc_id, CAST(start AS INT) AS start, CAST({counts} AS INT) AS score, win FROM listed)"""


def _snippets(order: str) -> str:
    return f"""{_first(QUERY)}, {_windows(QUERY)}, best AS (SELECT doc_id, start, win FROM windows WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {order}) = 1)
      SELECT rank, doc_id, start, translate(substring(win, 1, 511), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS snippet
      FROM ranked LEFT JOIN best USING (doc_id)"""


TERMS = ", ".join(f"'{t}'" for t in LIST_TERMS)
PAGES = BASE.replace(
    "SELECT doc_id, text FROM documents WHERE text IS NOT NULL", "SELECT doc_id, url, coalesce(text, '') AS text FROM documents WHERE url LIKE 'h%'"
).replace("strlen(text) AS doc_size", "strlen(url) + 1 + strlen(text) AS doc_size")
URL = "CASE WHEN strlen(url) >= 1000 THEN substring(url, 1, 1) ELSE url END AS url"

SQL = {
    "tokens_per_doc": f"{BASE} SELECT doc_id, count(*) AS n_tokens FROM tokens GROUP BY doc_id",
    "long_token_drop_count": f"{BASE} SELECT count(*) FILTER (length(w) > 15) AS n_dropped FROM found",
    "postings": f"{BASE} SELECT term, doc_id, freq FROM postings",
    "lexicon_df_cf": f"{BASE} SELECT term, df, cf FROM lex",
    "lexicon_range": f"{BASE} SELECT term, df FROM lex WHERE term BETWEEN 'm' AND 'p' ORDER BY term",
    "term_ids_first_seen": f"""{BASE}, first AS (SELECT term, min(struct_pack(d := doc_id, p := pos)) AS f FROM tokens GROUP BY term)
      SELECT term, row_number() OVER (ORDER BY f.d, f.p) - 1 AS term_id FROM first""",
    "doc_table": f"{BASE} SELECT doc_id, doc_size FROM docs",
    "corpus_stats": f"{BASE} SELECT n_docs, round(avg_doc_size, 6) AS avg_doc_size FROM stats",
    "build_summary": f"""{BASE} SELECT (SELECT count(*) FROM docs) AS n_docs, count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS n_postings,
      CAST(sum(cf) AS BIGINT) AS n_tokens FROM lex""",
    "bm25_single_term": f"{_scored('lexicon')} SELECT doc_id, bm25 FROM hits",
    "bm25_all_scores": f"{_scored(QUERY)} SELECT doc_id, bm25 FROM hits",
    "bm25_or_top10": f"{_first(QUERY)} SELECT * FROM ranked",
    "bm25_and_top10": f"{_first('the river path', True)} SELECT * FROM ranked",
    "and_match_count": f"{_scored('the river path', True)} SELECT count(*) AS n FROM hits",
    "or_match_count": f"{_scored('the river path')} SELECT count(*) AS n FROM hits",
    "unknown_terms_ignored": f"{_first('the river path', True)} SELECT * FROM ranked",
    "bm25_repeated_term": f"{_scored('river path river')} SELECT doc_id, bm25 FROM hits",
    "bm25_negative_idf": f"{_scored('the of', True)} SELECT doc_id, bm25 FROM hits",
    "batch_queries_topk": _batch(False),
    "batch_queries_all_words": _batch(True),
    "list_lengths_order": f"{BASE} SELECT CAST(row_number() OVER (ORDER BY df, term) AS INT) AS place, term, df FROM lex WHERE term IN ({TERMS})",
    "next_geq": f"""{BASE} SELECT term, coalesce(min(doc_id) FILTER (doc_id >= {SEEK}), any_value(n_docs)) AS doc_id
      FROM postings, stats WHERE term IN ({TERMS}) GROUP BY term""",
    "posting_gaps": f"{GAPS} SELECT term, doc_id, freq, gap, place FROM gaps",
    "posting_blocks": f"{BLOCKS} SELECT term, block_no, n, last_doc, block_bytes FROM blocks",
    "list_bytes_offsets": f"""{BYTES} SELECT term, df, list_bytes,
      CAST(coalesce(sum(list_bytes) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS list_offset FROM bytes""",
    "index_size_summary": f"""{BYTES} SELECT (SELECT count(*) FROM blocks) AS n_blocks, CAST(sum(list_bytes) AS BIGINT) AS index_bytes,
      CAST(sum(strlen(term) + 12) AS BIGINT) AS lexicon_bytes FROM bytes""",
    "varbyte_hex": f"""{BASE} SELECT freq, array_to_string(list_transform(range(0, {_vb("freq")}),
      lambda i: printf('%02X', ((freq >> (7 * i)::INT) & 127) + CASE WHEN i = {_vb("freq")} - 1 THEN 128 ELSE 0 END)), '') AS bytes
      FROM (SELECT DISTINCT freq FROM postings)""",
    "snippet_windows": f"{BASE}, {_windows(QUERY)} SELECT doc_id, start, score FROM windows",
    "best_snippet": _snippets("score DESC, start"),
    "observed_last_snippet": _snippets("start DESC"),
    "prefix_sample": f"""{BASE}, placed AS (SELECT doc_id, CAST(coalesce(sum(doc_size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM docs) SELECT doc_id, before FROM placed WHERE before < (SELECT floor(sum(doc_size) / 10.0) * 3 FROM docs)""",
    "run_merge": f"{BASE} SELECT term, doc_id, freq FROM postings",
    "posting_dump": f"{PAGES} SELECT doc_id, freq, {URL} FROM postings JOIN texts USING (doc_id) WHERE term = 'river'",
    "doc_fetch": f"{_first(QUERY)} SELECT rank, doc_id, substring(text, 1, 100) AS body FROM ranked JOIN texts USING (doc_id)",
    "pages_or_top10": f"{_first(QUERY).replace(BASE, PAGES)} SELECT rank, doc_id, {URL}, bm25 FROM ranked JOIN texts USING (doc_id)",
    "observed_tail_tokens": f"""{BASE.replace("regexp_extract_all(text,", "regexp_extract_all(regexp_replace(text, '[A-Za-z0-9]+$', ''),")}
      SELECT doc_id, count(*) AS n_tokens FROM tokens GROUP BY doc_id""",
    "observed_key14_lexicon": f"{BASE} SELECT substring(term, 1, 14) AS prefix, max(term) AS term FROM lex GROUP BY prefix",
    "varbyte_decoded": f"{GAPS} SELECT term, place // 128 AS block_no, CAST(place % 128 AS INT) AS nth, gap FROM gaps",
    "nested_lists": f"""{BASE} SELECT term, doc_id // {SPAN} AS slice, string_agg(doc_id || ':' || freq, ' ' ORDER BY doc_id) AS list
      FROM postings GROUP BY ALL""",
    "observed_without_last_term": f"{BASE} SELECT term, doc_id, freq FROM postings WHERE term <> (SELECT max(term) FROM lex)",
    "observed_key14_top10": _first(CUT_QUERY).replace(
        _q(CUT_QUERY),
        _q(CUT_QUERY).replace("typed AS", "whole AS")
        + """, cut AS (SELECT substring(term, 1, 14) AS prefix, CAST(sum(repeats) AS INT) AS repeats FROM whole GROUP BY prefix),
      last AS (SELECT substring(term, 1, 14) AS prefix, max(term) AS term FROM lex GROUP BY prefix),
      typed AS (SELECT term, repeats FROM cut JOIN last USING (prefix))""",
    )
    + " SELECT * FROM ranked",
    "limits_and_modes": """SELECT l AS result_limit, m AS mode, l >= 1 AND m IN (0, 1) AS accepted
      FROM (VALUES (-1), (0), (1), (10)) AS limits(l), (VALUES (-1), (0), (1), (2)) AS modes(m)""",
}
