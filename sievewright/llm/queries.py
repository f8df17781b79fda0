"""One thin query per operator: production parameters, whole tables, and the columns of its contract."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, extraction, jaccard, language, middles, mixing, neighbours, packing, quality, secrets, spelling, substrings, tokens
from .common import Stages, table, workdir


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document. The query starts from an empty cache of its own, so each run counts everything."""
    cache = f"{workdir(spark)}/token-cache-{uuid.uuid4().hex}"
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), cache)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and adaptive verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents"), Stages(spark)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"{m}_max" for m in quality.METRICS)
    )


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 0.9 over 3-word shingles."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), Stages(spark), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.mix(table(spark, sf_dir, "documents"), Stages(spark)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 50 words that an earlier document has."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), Stages(spark)).drop("kept")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.extract(table(spark, sf_dir, "pages"), Stages(spark))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's score and verdict; values appear as previews and digests."""
    return secrets.report(table(spark, sf_dir, "documents"), secrets.forest(spark))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every 50th vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), Stages(spark), 5)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), Stages(spark))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every document is cut and laid out, with digests of the output and of the text restored from it."""
    made = middles.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(middles.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts, and whether it is the one that stays."""
    return exact.exact_groups(table(spark, sf_dir, "documents"), Stages(spark))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words, its form and the root that forms lead to."""
    return spelling.spelling_groups(table(spark, sf_dir, "documents"), Stages(spark))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_source_mixing": op5_source_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_secret_scans": op8_secret_scans,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES: dict[str, str] = {
    "op4_ngram_jaccard": """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        both_ways AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM both_ways JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
    "op6_substring_dedup": """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
        first AS (SELECT run, min(doc_id) AS d FROM runs GROUP BY run),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM runs JOIN first USING (run) WHERE d < doc_id),
        each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM documents),
        r AS (SELECT *, len(u)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS x FROM d),
        c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
        p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_exact_dedup": """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents),
        g AS (SELECT t, count(*) AS group_size, max(n) AS most FROM d GROUP BY t),
        k AS (SELECT t, min(doc_id) AS keep_id FROM d JOIN g USING (t) WHERE n = most GROUP BY t)
        SELECT doc_id, keep_id, group_size, n = most AND doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t) JOIN k USING (t)""",
    "op13_spelling_variants": """WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256))::BIGINT AS i)),
        runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
        bytes AS (SELECT r, n, hex(encode(d || ':' || r)) AS x FROM runs),
        crc AS (SELECT r, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) AS h FROM bytes, tab),
        cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w, n FROM crc),
        words AS (SELECT w, sum(n)::BIGINT AS n FROM cut WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
        k AS (SELECT w, n, substr(w, 1, i - 1) AS a, substr(w, i + 1) AS b FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)),
        less AS (SELECT DISTINCT k.w AS w, v.w AS v FROM k JOIN words v ON v.w = a || b),
        near AS (SELECT x.w AS w, y.w AS v FROM k x JOIN k y ON x.a || '*' || x.b = y.a || '*' || y.b AND x.w <> y.w UNION SELECT w, v FROM less UNION SELECT v, w FROM less),
        best AS (SELECT near.w, count(*) AS n_near, arg_min(v, (-words.n, v)) AS v, max(words.n) AS m FROM near JOIN words ON words.w = v GROUP BY near.w),
        forms AS (SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * words.n THEN v END AS form, CASE WHEN m >= 2 * words.n THEN m END AS form_n FROM words LEFT JOIN best USING (w)),
        way AS (SELECT w, w AS z FROM forms UNION ALL SELECT way.w, form FROM way JOIN forms ON forms.w = z WHERE form IS NOT NULL)
        SELECT w AS word, form, z AS root, n, n_near, form_n FROM forms JOIN (SELECT way.w, z FROM way JOIN forms ON forms.w = z WHERE form IS NULL) USING (w)""",
}
