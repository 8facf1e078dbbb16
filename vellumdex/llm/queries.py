"""Queries of the problems in this package, and their SQL."""

from vellumdex.llm import distinct_terms, encode, language, mixing, term_counts, top_lists, top_words
from vellumdex.sources.tables import table

CLEAN = """clean AS (
  SELECT run_id, term_id, doc_id, freq FROM term_chunk WHERE term_id IS NOT NULL AND doc_id IS NOT NULL AND freq >= 1
  QUALIFY row_number() OVER (PARTITION BY term_id, doc_id ORDER BY loaded_at DESC NULLS LAST, freq DESC, run_id DESC NULLS LAST) = 1)"""
SIZES = """sizes AS (
  SELECT doc_id, CASE WHEN size_of_doc >= 1 THEN size_of_doc END AS size FROM doc_entry WHERE doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC NULLS LAST, size_of_doc DESC NULLS LAST) = 1)"""


def p2_found(spark, sf):
    return distinct_terms.marking_terms(table(spark, sf, "term_chunk"), table(spark, sf, "doc_entry"))


def p2_weights(spark, sf):
    found = distinct_terms.term_weights(table(spark, sf, "term_chunk"), table(spark, sf, "doc_entry"))
    rounded = {c: f"round({c}, 6)" for c in ("distinctness", "weight", "strength")}
    return found.selectExpr(*(f"{rounded[c]} AS {c}" if c in rounded else c for c in found.columns))


def p3_found(spark, sf):
    return top_words.frequent_words(table(spark, sf, "term_chunk"), table(spark, sf, "lexicon")).selectExpr("word AS term")


def p3_top_words(spark, sf):
    return top_words.most_frequent_words(table(spark, sf, "term_chunk"), table(spark, sf, "lexicon"))


def p3_estimates(spark, sf):
    return top_words.estimated_words(table(spark, sf, "term_chunk"), table(spark, sf, "lexicon"))


def p4_found(spark, sf):
    return top_lists.top_documents(table(spark, sf, "term_chunk"), table(spark, sf, "doc_entry")).select("run_id", "term_id", "doc_id")


def p4_ranked(spark, sf):
    return top_lists.top_documents(table(spark, sf, "term_chunk"), table(spark, sf, "doc_entry"), 10)


def p5_found(spark, sf):
    return term_counts.marked_terms(table(spark, sf, "term_chunk"))


def p5_term_counts(spark, sf):
    return term_counts.term_frequencies(table(spark, sf, "term_chunk"))


def p6_ids(spark, sf):
    return encode.token_ids(table(spark, sf, "documents"))


def p6_token_counts(spark, sf):
    return encode.token_counts(table(spark, sf, "documents"))


def p7_found(spark, sf):
    return mixing.short_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_mix(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), own_first=True)[0]


def p7_shares(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), own_first=True)[1]


def p8_found(spark, sf):
    return language.language_cases(table(spark, sf, "documents"), table(spark, sf, "lang_reference"))


def p8_languages(spark, sf):
    return language.languages(table(spark, sf, "documents"), table(spark, sf, "lang_reference"))


QUERIES = {f.__name__: f for f in (p2_found, p2_weights, p3_found, p3_top_words, p3_estimates, p4_found, p4_ranked, p5_found, p5_term_counts, p6_ids, p6_token_counts, p7_found, p7_mix, p7_shares, p8_found, p8_languages)}

WORDS = f"""WITH {CLEAN}, words AS (
    SELECT run_id, term_id, lower(trim(term, ' ')) AS word FROM lexicon
    QUALIFY row_number() OVER (PARTITION BY run_id, term_id ORDER BY written_at DESC NULLS LAST, term DESC NULLS LAST) = 1),
  sums AS (SELECT word, CAST(sum(freq) AS BIGINT) AS occurrences FROM clean LEFT JOIN words USING (run_id, term_id) GROUP BY word)"""
LISTED = f"""WITH {CLEAN}, {SIZES}
  SELECT run_id, term_id, doc_id, CAST(row_number() OVER (
    PARTITION BY run_id, term_id ORDER BY freq DESC, size ASC NULLS LAST, doc_id) AS INT) AS rank
  FROM clean LEFT JOIN sizes USING (doc_id)"""

SQL = {
    "p2_found": f"""WITH {CLEAN}, {SIZES}, df AS (SELECT term_id, count(*) AS df FROM clean GROUP BY term_id)
        SELECT doc_id, term_id FROM clean JOIN df USING (term_id) JOIN sizes USING (doc_id)
        WHERE df BETWEEN 2 AND 25 AND freq >= 4 AND CAST(freq AS BIGINT) * 1000 >= 20 * size""",
    "p2_weights": f"""WITH {CLEAN}, {SIZES},
        n AS (SELECT count(DISTINCT doc_id) AS n FROM clean),
        share AS (SELECT term_id, freq, CAST(sum(freq) OVER (PARTITION BY term_id) AS BIGINT) AS gf FROM clean),
        terms AS (SELECT term_id, count(*) AS df, max(gf) AS gf, -sum(freq / CAST(gf AS DOUBLE) * ln(freq / CAST(gf AS DOUBLE))) AS h
                  FROM share GROUP BY term_id),
        g AS (SELECT term_id, df, gf, 1 - CASE WHEN df < 2 OR n < 2 THEN 0 ELSE greatest(0, least(1, h / ln(n))) END AS d FROM terms, n)
        SELECT doc_id, term_id, freq, size, df, gf AS occurrences, round(d, 6) AS distinctness,
          round(log2(1 + freq) * d, 6) AS weight, round(log2(1 + freq * 1000.0::DOUBLE / size) * d, 6) AS strength
        FROM clean JOIN g USING (term_id) LEFT JOIN sizes USING (doc_id)""",
    "p3_found": f"{WORDS} SELECT word AS term FROM sums WHERE word IS NOT NULL AND occurrences * 200 >= (SELECT sum(occurrences) FROM sums)",
    "p3_top_words": f"""{WORDS}, ranked AS (
        SELECT word, occurrences, CAST(row_number() OVER (ORDER BY occurrences DESC, word) AS INT) AS rank FROM sums WHERE word IS NOT NULL)
        SELECT word, occurrences, rank FROM ranked WHERE rank <= 50""",
    "p4_found": f"SELECT run_id, term_id, doc_id FROM ({LISTED}) WHERE rank <= 3",
    "p4_ranked": f"SELECT run_id, term_id, doc_id, rank FROM ({LISTED}) WHERE rank <= 10",
    "p5_term_counts": f"""WITH {CLEAN}, n AS (SELECT count(DISTINCT doc_id) AS n FROM clean)
        SELECT term_id, count(*) AS docs, CAST(sum(freq) AS BIGINT) AS occurrences,
          CASE WHEN count(*) * 5 >= max(n) THEN 'common' WHEN count(*) < 3 OR sum(freq) < 4 THEN 'rare' END AS mark
        FROM clean, n GROUP BY term_id""",
}
SQL["p5_found"] = f"SELECT term_id, mark FROM ({SQL['p5_term_counts']}) WHERE mark IS NOT NULL"
