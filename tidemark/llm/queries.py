"""One query per text operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from .collocations import collocations
from .common import fold, table
from .exact_dedup import exact_duplicates
from .fingerprints import fingerprints_with_next
from .html_text import main_text
from .merkle import manifest
from .near_dedup import near_duplicates
from .packing import best_fit
from .pii import KINDS as PII_KINDS
from .pii import personal_data
from .quality import quality
from .secrets import KINDS as SECRET_KINDS
from .secrets import secret_spans
from .segmentations import decoded, sampled_segmentations
from .sharding import shards
from .toxicity import toxicity


def op1_personal_data(spark, sf_dir):
    found, spans = personal_data(table(spark, sf_dir, "documents")), F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*PII_KINDS))
    return found.select("doc_id", *(counted(spans, k) for k in PII_KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans"))


def op3_fingerprints(spark, sf_dir):
    return fingerprints_with_next(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark, sf_dir):
    return best_fit(table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality(docs, labels.where(fold("doc_id", 3) != 1))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


def spans_text(spans):
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op7_secret_scan(spark, sf_dir):
    found, spans = secret_spans(table(spark, sf_dir, "documents")), F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*SECRET_KINDS))
    return found.select("doc_id", *(counted(spans, k) for k in SECRET_KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans"))


def op8_sampled_segmentations(spark, sf_dir):
    found = decoded(sampled_segmentations(table(spark, sf_dir, "documents"), ("doc_id",)), text="decoded")
    return found.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


def op9_main_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


def op10_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity(docs, labels.where(fold("doc_id", 5) != 0))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence")


def op11_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"), tampered=fold("doc_id", 5) == 0)


def op12_byte_shards(spark, sf_dir):
    return shards(table(spark, sf_dir, "documents"))


def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op3_fingerprints": op3_fingerprints,
    "op2_near_dedup": op2_near_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality": op5_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_sampled_segmentations": op8_sampled_segmentations,
    "op9_main_text": op9_main_text,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_byte_shards": op12_byte_shards,
    "op13_collocations": op13_collocations,
}

#: crc32 by bytes: `crc` is its table, `_crc32` the sum of a text's UTF-8.
_CRC = "crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b)) AS tab)"


def _crc32(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')".format
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = "sha256(" + " || ".join(_FIELD(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
_LEVELS = """SELECT tree, 0 AS k, pos, digest, count(*) OVER (PARTITION BY tree) AS n FROM {0}
            UNION ALL SELECT tree, k + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM {1} WHERE n > 1 GROUP BY tree, k, pos // 16, n"""

ORACLES = {
    "op6_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op11_merkle_manifest": f"""
        WITH RECURSIVE {_CRC},
        leaves AS (
            SELECT doc_id, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
                   {_LEAF.format(_FIELD("text"))} AS digest,
                   CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_LEAF.format(_FIELD(_LOWER))} ELSE {_LEAF.format(_FIELD("text"))} END AS shown
            FROM documents, crc),
        low AS ({_LEVELS.format("leaves", "low")}),
        tops AS (SELECT '' AS tree, tree AS of_tree, row_number() OVER (ORDER BY tree) - 1 AS pos, digest FROM low WHERE n = 1),
        high AS ({_LEVELS.format("tops", "high")}),
        runs AS (SELECT tree, k, pos // 16 AS run, pos, digest, 'low' AS part FROM low WHERE n > 1
                 UNION ALL SELECT tree, k, pos // 16, pos, digest, 'high' FROM high WHERE n > 1),
        places AS (SELECT l.*, t.pos AS top_pos, t.digest AS subroot FROM leaves l JOIN tops t ON l.tree = t.of_tree),
        steps AS (
            SELECT doc_id, (part = 'high')::INT AS part, k,
                   coalesce(string_agg(r.digest, '' ORDER BY r.pos) FILTER (r.pos < p.own // (16 ** k)::BIGINT), '') || '|' || coalesce(string_agg(r.digest, '' ORDER BY r.pos) FILTER (r.pos > p.own // (16 ** k)::BIGINT), '') AS step
            FROM (SELECT doc_id, tree, pos AS own, 'low' AS part FROM places UNION ALL SELECT doc_id, '', top_pos, 'high' FROM places) p
            JOIN runs r USING (tree, part) WHERE r.run = p.own // (16 ** (k + 1))::BIGINT GROUP BY ALL),
        proofs AS (SELECT doc_id, list(step ORDER BY part, k) AS steps FROM steps GROUP BY doc_id),
        folds AS (
            SELECT p.doc_id, p.digest AS leaf, p.subroot, (SELECT digest FROM high WHERE n = 1) AS root,
                   sha256(replace(coalesce(array_to_string(steps, ''), ''), '|', '')) AS proof_sha256,
                   list_reduce(coalesce(steps, []), lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2)), p.shown) AS folded_root
            FROM places p LEFT JOIN proofs USING (doc_id))
        SELECT *, folded_root = root AS verified FROM folds
    """,
    "op12_byte_shards": f"""
        WITH {_CRC},
        t AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
        s AS (SELECT *, CAST((2 * sum(size) OVER (ORDER BY doc_id) - size) * 8 // (2 * sum(size) OVER ()) AS INTEGER) AS shard FROM t)
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
    """,
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
        grams AS (
            SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS m)),
        f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
        total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
        cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
        cuts AS (SELECT *, unnest(range(1, m)) AS k FROM cand),
        scored AS (
            SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, CAST(1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a) AS BIGINT) AS score
            FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 :], ' ')),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_ AS (SELECT lang, a AS longer, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM cand WHERE m = 3),
        held AS (SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN inner_ i ON c.lang = i.lang AND c.phrase = i.phrase WHERE c.m = 2 AND 100 * i.longer >= 50 * c.a),
        kept AS (SELECT b.* FROM best b LEFT JOIN held h ON b.lang = h.lang AND b.phrase = h.phrase WHERE h.phrase IS NULL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
    """.replace("\\\\", "\\"),
}
