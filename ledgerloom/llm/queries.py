"""Registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import (
    bradley_terry,
    decision_list,
    group_join,
    line_dedup,
    mixing,
    packing,
    periodic_runs,
    sharding,
    spelling,
    stream_dedup,
    token_counts,
    toxicity,
    url_lm,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op2_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.dedup_report(_table(spark, sf_dir, "documents"))


def op5_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.judge_urls(_table(spark, sf_dir, "pages"))


def op6_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op7_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op9_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bradley_terry.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_wildcard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(_table(spark, sf_dir, "documents"), typed=spelling.planted_typos)


def op12_perfect_hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(line_dedup.drop_common_lines(_table(spark, sf_dir, "documents")))


def op13_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.repeated_parts(_table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


QUERIES = {
    f.__name__: f
    for f in (
        op1_rendezvous_shards,
        op2_raked_mixture,
        op3_decision_list,
        op4_streaming_dedup,
        op5_url_language_models,
        op6_token_group_join,
        op7_minimum_bin_slack,
        op8_pretoken_counts,
        op9_clause_grammar,
        op10_bradley_terry,
        op11_wildcard_groups,
        op12_perfect_hash_lines,
        op13_harmonic_runs,
    )
}

#: crc32 of a list of bytes, by the table of its polynomial.
_CRC_TABLE = """
        crc_table as (
            select list(list_reduce(
                list_prepend(b, range(8)),
                lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end
            ) order by b) as t
            from range(256) r(b)
        )"""
_CRC = """xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""
_BYTES = """list_transform(range(0, length(hex({text})), 2), lambda i:
                16 * (instr('0123456789ABCDEF', substr(hex({text}), i + 1, 1)) - 1)
                + instr('0123456789ABCDEF', substr(hex({text}), i + 2, 1)) - 1)"""
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op4_streaming_dedup": """
        with n as (
            select doc_id, length(coalesce(text, '')) as points,
                   sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256
            from documents
        )
        select doc_id,
               first_value(doc_id) over w as keep_id,
               count(*) over (partition by text_sha256) as group_size,
               row_number() over w = 1 as kept,
               text_sha256
        from n
        window w as (partition by text_sha256 order by points desc, doc_id)
    """,
    "op11_wildcard_groups": f"""
        with recursive {_CRC_TABLE},
        runs as (
            select doc_id, {_LOWER.format(text="run")} as run, count(*) as m
            from (
                select row_number() over () as rid, doc_id,
                       unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as run
                from documents
            )
            where length(run) >= 6
            group by rid, doc_id, {_LOWER.format(text="run")}
        ),
        keyed as (select run, m, concat(coalesce(cast(doc_id as varchar), ''), ':', run) as key from runs),
        hashed as (select run, m, {_CRC.format(bytes=_BYTES.format(text="key"))} as h from keyed, crc_table),
        typed as (
            select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, m
            from hashed
        ),
        words as (
            select word, cast(sum(m) as bigint) as n from typed where length(word) >= 6 group by word having sum(m) >= 5
        ),
        places as (select word, n, unnest(range(length(word))) as i from words),
        cut as (select word, n, i, substr(word, 1, i) as a, substr(word, i + 2) as z from places),
        shorter as (select distinct word, n, a || z as name from cut),
        pairs as (
            select c.word, d.word as other, d.n as other_n
            from cut c join cut d on c.i = d.i and c.a = d.a and c.z = d.z and c.word <> d.word
            union all
            select s.word, w.word, w.n from shorter s join words w on s.name = w.word
            union all
            select w.word, s.word, s.n from shorter s join words w on s.name = w.word
        ),
        near as (
            select word, count(*) as n_near, max(other_n) as top_n, arg_min(other, (-other_n, other)) as top from pairs group by word
        ),
        forms as (
            select w.word, w.n, coalesce(n_near, 0) as n_near,
                   case when top_n >= 5 * w.n then top end as form,
                   case when top_n >= 5 * w.n then top_n end as form_n
            from words w left join near using (word)
        ),
        chain as (
            select word, word as here, 0 as steps from words
            union all
            select c.word, f.form, c.steps + 1 from chain c join forms f on f.word = c.here where f.form is not null
        )
        select f.word, f.form, (select arg_max(here, steps) from chain c where c.word = f.word) as root, f.n, f.n_near, f.form_n
        from forms f
    """,
    "op12_perfect_hash_lines": f"""
        with docs as (
            select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
        ),
        each as (
            select rid, doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from docs
        ),
        keyed as (
            select rid, doc_id, line, i,
                   {_LOWER.format(text="trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key
            from each
        ),
        common as (select key from keyed where key <> '' group by key having count(distinct rid) >= 10)
        select doc_id, count(*) as n_lines, count(c.key) as n_dropped,
               sha256(coalesce(string_agg(case when c.key is null then line end, chr(10) order by i), '')) as kept_sha256
        from keyed k left join common c on k.key = c.key
        group by rid, doc_id
    """,
    "op13_harmonic_runs": f"""
        with {_CRC_TABLE},
        docs as (
            select row_number() over () as rid, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
                   {_CRC.format(bytes=_BYTES.format(text="cast(doc_id as varchar)"))} as h
            from documents, crc_table
        ),
        sized as (select rid, doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as repeats, h // 10 as g from docs),
        planned as (
            select *, case when repeats then g % n end as a,
                   case when repeats then 1 + (n - g % n) // (3 + g % 8) end as p
            from sized
        ),
        words as (
            select rid, n, i, case when repeats and i >= a then w[a + (i - a) % p + 1] else w[i + 1] end as word
            from (select *, unnest(range(n)) as i from planned)
        ),
        equal as (
            select x.rid, x.i, y.i - x.i as p
            from words x join words y on x.rid = y.rid and x.word = y.word and y.i > x.i and 3 * (y.i - x.i) <= x.n
        ),
        islands as (
            select rid, p, min(i) as start, count(*) + p as length
            from (select *, i - row_number() over (partition by rid, p order by i) as island from equal)
            group by rid, p, island
            having count(*) + p >= greatest(24, 3 * p)
        ),
        runs as (select rid, start, length, min(p) as period from islands group by rid, start, length),
        summed as (
            select rid, count(*) as n_runs,
                   string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed,
                   arg_min(struct_pack(s := start, l := length, p := period), (-length::double / period, start, period)) as best
            from runs group by rid
        ),
        dropped as (select distinct rid, unnest(range(start + period, start + length)) as i from runs),
        left_over as (
            select w.rid, string_agg(word, ' ' order by w.i) as text
            from words w anti join dropped d on w.rid = d.rid and w.i = d.i group by w.rid
        )
        select doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.l as length, best.p as period,
               1000 * best.l // best.p as exponent_milli,
               sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(text, '')) as collapsed_sha256
        from docs left join summed using (rid) left join left_over using (rid)
    """,
}
