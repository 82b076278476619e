"""DuckDB SQL for the queries that SQL can express.

Not here: fingerprints (1) need XXH64 and conversations (12) CRC-32, which DuckDB has no function for; 3, 5, 6
and 9 are trained; 4 and 10 need a tokenizer's vocabulary; 13 has Bloom filters.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOWERED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str, n: int) -> str:
    """Distinct n-word shingles of a table's texts; the whole sequence where there are fewer words."""
    return f"""SELECT DISTINCT {key}, CASE WHEN len(w) < {n} THEN array_to_string(w, ' ')
        ELSE array_to_string(w[i:i+{n - 1}], ' ') END AS s
        FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i
              FROM (SELECT {key}, {_LOWERED} AS w FROM {table}) WHERE len(w) > 0)"""


SQL = {
    "op2_decontaminate": f"""WITH d AS ({_shingles("documents", "doc_id", 5)}),
        b AS ({_shingles("benchmark", "item_id", 5)}),
        n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
        f AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN b USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
        FROM f JOIN n USING (item_id) WHERE n_found / n_shingles >= 0.8""",
    # every 13-word window that starts in a document with a smaller id takes its words out
    "op8_substrings": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
        x AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM p),
        m AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s HAVING min(doc_id) < max(doc_id)),
        r AS (SELECT DISTINCT doc_id, i + k AS i FROM
              (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM x JOIN m USING (s) WHERE first < doc_id)),
        t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS kept, count(*) AS n
              FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND t.i = r.i WHERE r.i IS NULL GROUP BY t.doc_id)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    # f: all phrases; c: candidates; b: their lowest cut; o: the best longer candidate around each
    "op11_phrases": rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang,
              unnest(regexp_extract_all({_LOWER}, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
        q AS (SELECT lang, row_number() OVER () AS q, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        n AS (SELECT lang, sum(len(w)) AS n FROM q GROUP BY lang),
        u AS (SELECT lang, q, unnest(w) AS a, unnest(range(len(w))) AS i FROM q),
        v AS (SELECT lang, a, lead(a, 1) OVER t AS b, lead(a, 2) OVER t AS c, lead(a, 3) OVER t AS d FROM u WINDOW t AS (PARTITION BY q ORDER BY i)),
        f AS MATERIALIZED (SELECT lang, 1 AS d, a AS phrase, count(*) AS f FROM v GROUP BY ALL
              UNION ALL SELECT lang, 2, a || ' ' || b, count(*) FROM v WHERE b IS NOT NULL GROUP BY ALL
              UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, count(*) FROM v WHERE c IS NOT NULL GROUP BY ALL
              UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d, count(*) FROM v WHERE d IS NOT NULL GROUP BY ALL),
        c AS (SELECT lang, d, phrase, f AS a, string_split(phrase, ' ') AS v FROM f WHERE d >= 2 AND f >= 30),
        k AS (SELECT lang, phrase, a, k, array_to_string(v[1:k], ' ') AS lp, array_to_string(v[k+1:], ' ') AS rp
              FROM c, range(1, 4) AS r(k) WHERE k < d),
        x AS MATERIALIZED (SELECT k.*, f.f AS l FROM k JOIN f ON f.lang = k.lang AND f.phrase = lp),
        s AS MATERIALIZED (SELECT x.lang, x.phrase, a, k, l, f.f AS r, (2000000::HUGEINT * a) // (l + f.f) AS score
              FROM x JOIN f ON f.lang = x.lang AND f.phrase = rp),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        z AS (SELECT lang, a, v, m, unnest(range(1, d - m + 2)) AS i FROM c, range(2, 4) AS r(m) WHERE m < d),
        o AS (SELECT lang, array_to_string(v[i:i+m-1], ' ') AS phrase, max(a) AS longer FROM z GROUP BY ALL),
        e AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
              WHERE longer IS NULL OR 100 * longer < 80 * a),
        t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
        SELECT t.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
               CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM t JOIN n USING (lang) WHERE rank <= 2000""",
}
