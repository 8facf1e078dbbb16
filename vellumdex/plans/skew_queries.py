"""Queries of problem 1: a few terms hold most postings."""

from vellumdex.operators.skew import heavy_terms, per_term_loads
from vellumdex.sources.tables import table


def p1_found(spark, sf):
    return heavy_terms(table(spark, sf, "term_chunk"), 0.01)


def p1_term_loads(spark, sf):
    return per_term_loads(table(spark, sf, "term_chunk"), table(spark, sf, "term_entry"))


QUERIES = {"p1_found": p1_found, "p1_term_loads": p1_term_loads}

SQL = {
    "p1_found": """
        SELECT term_id FROM term_chunk WHERE term_id IS NOT NULL GROUP BY term_id
        HAVING count(*) * 100 >= (SELECT count(*) FROM term_chunk)""",
    "p1_term_loads": """
        WITH clean AS (
          SELECT term_id, doc_id, freq FROM term_chunk
          WHERE term_id IS NOT NULL AND doc_id IS NOT NULL AND freq >= 1
          QUALIFY row_number() OVER (PARTITION BY term_id, doc_id ORDER BY loaded_at DESC NULLS LAST, freq DESC) = 1),
        tallies AS (SELECT term_id, count(*) AS postings, CAST(sum(freq) AS BIGINT) AS occurrences FROM clean GROUP BY term_id),
        entries AS (
          SELECT run_id, term_id, tc_length FROM term_entry WHERE term_id IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY run_id, term_id ORDER BY written_at DESC NULLS LAST, tc_length DESC NULLS LAST) = 1),
        stated AS (SELECT term_id, CAST(sum(CASE WHEN tc_length >= 0 THEN tc_length END) AS BIGINT) AS stated FROM entries GROUP BY term_id)
        SELECT r.term_id, r.n_rows, coalesce(t.postings, 0) AS postings, coalesce(t.occurrences, 0) AS occurrences, s.stated
        FROM (SELECT term_id, count(*) AS n_rows FROM term_chunk WHERE term_id IS NOT NULL GROUP BY term_id) r
        LEFT JOIN tallies t ON r.term_id = t.term_id LEFT JOIN stated s ON r.term_id = s.term_id""",
}
