"""The opN queries: thin digests of the operators over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, exact_dedup, kd_search, language_id, licenses, minhash, mixing, secrets, suffix_dedup, suffix_tree_lm


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return language_id.identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), F.array_join("matches", ",").alias("matches"), "n_licenses")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), tokenizer_file()), tokenizer_file())
    ids = F.array_join("ids", " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    scores = suffix_tree_lm.lm_score(docs, ~F.coalesce(held_out, F.lit(False)))
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, lambda k: F.when(k == F.lit(secrets.KINDS.index(name)), k)))).cast("long").alias(f"n_{name}") for name in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf_dir)
    return rows.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), "decoded_sha256")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_suffix_dedup, op3_language_id, op4_minhash, op5_license_scan, op6_bpe, op7_kd_top_k, op8_suffix_tree_lm, op9_mix_sources, op10_secret_scan, pipeline)}



def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8: its columns but the model's score, the base score rounded."""
    return op8_suffix_tree_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: sizes and targets, and that each source's words come near its target and no document past three times its size."""
    rows = op9_mix_sources(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    taken = rows.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("words"), F.max("target").alias("target"), F.max("size").alias("longest"))
    near = taken.select(F.col("source").alias("s"), (F.abs(F.col("words") - F.col("target")) <= F.greatest(F.col("longest"), F.lit(1))).alias("source_near_target"))
    out = rows.join(docs, "doc_id").join(near, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("within_three"), "source_near_target")


#: Parts of operators' results that SQL can check where it can't check the whole.
PARTS = {f.__name__: f for f in (lm_base_scores, mix_targets)}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def license_sql() -> str:
    """op5 in DuckDB: the same cuts without lookaround (a dot before a blank becomes a line end first)."""
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.SENTENCES.items())
    # a dot between digits stays: it is put aside as another sign, twice, since matches may share a digit
    aside = "regexp_replace(regexp_replace(lower(s), '([0-9])\\.([0-9])', '\\1\ue000\\2', 'g'), '([0-9])\\.([0-9])', '\\1\ue000\\2', 'g')"
    normal = f"trim(regexp_replace(replace(replace({aside}, '.', ' '), '\ue000', '.'), '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g'), ' ')"
    hits = []
    for name, kind, ids in licenses.RULES:
        wanted = "[" + ", ".join(map(_quoted, ids)) + "]"
        hits.append(f"list_transform(list_filter(range(0, greatest(len(ids) - {len(ids)} + 1, 0)), lambda i: list_slice(ids, i + 1, i + {len(ids)}) = {wanted}), lambda i: {_quoted(f'{name}:{kind}:')} || i)")

    def cut(name: str, end: str, breaks: str) -> str:
        pieces = f"string_split_regex(regexp_replace(lower(text), '\\.+(\\s|$)', '{end}', 'g'), '{breaks}')"
        return f"""{name}_parts as (select row, unnest({pieces}) as s, generate_subscripts({pieces}, 1) as place from t),
             {name} as (select row, list(id order by place) as ids from {name}_parts join known on {normal} = sentence group by row)"""

    cuts = ", ".join((cut("lines", "\n", r"[\n\r;!?]+"), cut("flowing", " ; ", "[;!?]+")))
    return f"""
        with known(sentence, id) as (values {known}),
             t as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
             {cuts},
             found as (select doc_id, case when len(coalesce(flowing.ids, [])) > len(coalesce(lines.ids, [])) then flowing.ids else coalesce(lines.ids, []) end as ids
                       from t left join lines on t.row = lines.row left join flowing on t.row = flowing.row),
             m as (select doc_id, ids, list_concat({hits[0]}, {", ".join(hits[1:])}) as matches from found),
             l as (select *, list_sort(list_distinct(list_transform(matches, lambda x: split_part(x, ':', 1)))) as licenses from m)
        select doc_id, array_to_string(ids, ',') as sentence_ids, array_to_string(licenses, ',') as licenses, array_to_string(matches, ',') as matches, cast(len(licenses) as bigint) as n_licenses from l"""


_WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB, which has no such function: bit by bit, each byte taken in before its first bit."""
    steps = f"list_transform(range(8 * length({text})), lambda i: case when i % 8 = 0 then cast(ascii({text}[i // 8 + 1]) as bigint) else 0 end)"
    taken = "xor(c, b)"
    bits = f"list_reduce(list_prepend(4294967295::bigint, {steps}), lambda c, b: case when ({taken} & 1) = 1 then xor({taken} >> 1, 3988292384) else {taken} >> 1 end)"
    return f"xor({bits}, 4294967295)"


ORACLE_SQL = {
    "op1_exact_dedup": """
        with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents)
        select doc_id, max(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
               doc_id is not distinct from max(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
        from t""",
    "op4_minhash": """
        with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
             s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
                                                       when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from t),
             n as (select doc_id, count(*) as n from s group by 1),
             shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
             e as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
             r as (select doc_id as a, doc_id as b from t union select r.a, e.b from r join e on r.b = e.a),
             k as (select a, min(b) as component_id from r group by 1)
        select t.doc_id, coalesce(n.n, 0) as n_shingles, component_id, t.doc_id = component_id as kept from t left join n on n.doc_id = t.doc_id join k on k.a = t.doc_id""",
    "op5_license_scan": license_sql(),
    "op7_kd_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
                   where embedding is not null and vec_id is not null and len(embedding) > 0
                     and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
             s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
                   from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
             r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10""",
    "lm_base_scores": f"""
        with t as (select row_number() over () as row, doc_id, coalesce({crc32_sql("cast(doc_id as varchar)")} % 5 = 1, false) as held_out, list_append({_WORDS.format(text=_LOWER)}, '') as w from documents),
             x as (select row, held_out, unnest(w) as word from t),
             c as (select word, count(*) as c from x where not held_out group by 1),
             k as (select coalesce(sum(c), 0) as n, count(*) as v from c),
             s as (select row, count(*) as n_tokens, count(c) as n_known, sum(log10((coalesce(c, 0) + 0.5::double) / (n + 0.5::double * (v + 1)))) as base_score, max(n) as n from x left join c using (word), k group by row)
        select doc_id, held_out, n_tokens, n_known, cast(n as bigint) as train_tokens, round(base_score, 3) as base_score from t join s using (row)""",
    "mix_targets": f"""
        with t as (select doc_id, source, cast(len({_WORDS.format(text="coalesce(text, '')")}) as bigint) as size from documents),
             p as (select source, cast(sum(size) as bigint) as source_size from t group by 1),
             r as (select *, 3.0::double * source_size as cap, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from p),
             q as (select *, sum(source_size) over () as words, sum(weight) over () as weights, coalesce(sum(cap) over w, 0) as bound, coalesce(sum(weight) over w, 0) as used from r window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
             l as (select max((words - bound) / (weights - used)) filter (where (words - bound) / (weights - used) * weight <= cap) as level from q)
        select doc_id, size, source_size, round(least(cap, coalesce(level * weight, cap)), 3) as target, true as within_three, true as source_near_target from t join q on t.source is not distinct from q.source, l""",
}
