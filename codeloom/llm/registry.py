"""The queries of this subpackage, by the name they are registered under, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from codeloom.llm import alignment, langid, lines, lm, minhash, mixing, packing, periodic, quality, suffixes, topk, toxicity, warc
from codeloom.llm.shared import WORD, table


def op1_top_k(spark, sf_dir):
    v = topk.whole_numbers(table(spark, sf_dir, "embeddings"))
    return topk.top_k(v.where("id % 50 = 0"), v, 5)


def op2_lm_scoring(spark, sf_dir):
    return lm.scored(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.scored(docs.select("doc_id", "text"), toxicity.fitted(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


def op5_suffix_dedup(spark, sf_dir):
    rows = suffixes.removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"])
    return rows.select(
        "row.doc_id",
        F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"),
        cut.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_quality_rules(spark, sf_dir):
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base, full = quality.fails(("base", 1)), quality.fails(("full", 1))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~(base | full)).alias("kept"))


def op7_minhash_groups(spark, sf_dir):
    rows = minhash.groups(table(spark, sf_dir, "documents"), 85)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_line_dedup(spark, sf_dir):
    return lines.report(table(spark, sf_dir, "documents"), short=1)


def op9_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mix_sources(spark, sf_dir):
    docs, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "size", "source_size", "target", "taken")


def op11_token_alignment(spark, sf_dir):
    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def repeated(docs):
    """docs with a periodic tail in each tenth text or so: doc_id, text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, g = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.floor(F.col("h") / 10)
    n, a = F.size("words"), F.col("a")
    some = docs.select("doc_id", "text", F.coalesce(h, F.lit(1)).alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    some = some.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", 1 + F.floor((n - a) / (3 + g % 8)).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i >= a, a + (i - a) % F.col("p")).otherwise(i)))
    return some.select("doc_id", F.when(n > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    rows = periodic.with_runs(repeated(table(spark, sf_dir, "documents")), "doc_id")
    # The longest run; of equally long ones the first, then the one of smallest period.
    longest = F.reduce("runs", F.get("runs", F.lit(0)), lambda x, r: F.when(r["length"] > x["length"], r).otherwise(x))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", "x.start", "x.length", "x.period", F.floor(1000 * F.col("x.length") / F.col("x.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_language_id(spark, sf_dir):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    rows = langid.labelled(docs, langid.fitted(docs.where("not held_out")), "doc_id", "held_out")
    return rows.select("doc_id", "held_out", "lang_pred", "score")


_TEXT = r"coalesce(text, '')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op1_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) e from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select q.vec_id query_id, c.vec_id vec_id,
   cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) score
  from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
 r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op6_quality_rules": rf"""
with d as (select doc_id, {_TEXT} t, {_WORDS} w from documents),
 tri as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d)),
 rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) n from tri) where n > 1),
 rw as (select doc_id, count(distinct i + k) n_repeat_words from rep, (values (0), (1), (2)) x(k) group by doc_id),
 li as (select doc_id, l from (select doc_id, unnest(string_split(t, chr(10))) l from d) where regexp_matches(l, '[^\x20\x09-\x0D]')),
 dl as (select doc_id, count(*) n_lines, count(*) - count(distinct l) n_dup_lines from li group by doc_id),
 m as (select d.doc_id, len(w) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars,
   length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols, coalesce(n_dup_lines, 0) n_dup_lines,
   coalesce(n_repeat_words, 0) n_repeat_words, coalesce(n_lines, 0) n_lines,
   length(regexp_replace(t, '[^A-Z]+', '', 'g')) n_upper, length(regexp_replace(t, '[^a-z]+', '', 'g')) n_lower
  from d left join rw using (doc_id) left join dl using (doc_id)),
 f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
   10 * n_symbols > 3 * n_words or (10 * n_dup_lines > 4 * n_lines and n_dup_lines >= 3)
   or word_chars < 2 * n_words or word_chars > 15 * n_words or n_upper > n_lower own_failed from m)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols,
 cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words, base_failed,
 not (base_failed or own_failed) kept from f""",
    "op7_minhash_groups": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
 s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from d where len(w) > 0)),
 n as (select doc_id, count(*) k from s group by doc_id),
 p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
 e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.k + b.k - c)),
 l as (select x, y from e union all select y, x from e),
 r as (select x as start, y as node from l union select r.start, l.y from r join l on r.node = l.x),
 m as (select start, min(node) least from r group by start)
select d.doc_id, coalesce(k, 0) n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) component_id, d.doc_id = least(d.doc_id, coalesce(m.least, d.doc_id)) kept
 from d left join n on d.doc_id = n.doc_id left join m on m.start = d.doc_id""",
    "op9_warc": """
with p as (select page_id, coalesce(html, '') t from pages), h as (select page_id, t, lower(sha1(t)) x from p),
 f as (select t, min(page_id) first from p group by t),
 d as (select h.*, first, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((instr('0123456789abcdef', x[(5 * i) // 4 + 1]) - 1) * 16
   + greatest(instr('0123456789abcdef', x[(5 * i) // 4 + 2]) - 1, 0)) >> (3 - (5 * i) % 4)) & 31)::int, 1)), '') digest from h join f using (t))
select page_id, cast(strlen(t) as bigint) payload_bytes, digest payload_digest, case when first = page_id then 'response' else 'revisit' end record_type,
 case when first <> page_id then first end refers_to from d""",
}


def queries() -> dict:
    import corpus_pipeline

    return {k: f for k, f in globals().items() if k.startswith("op")} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return dict(ORACLE)
