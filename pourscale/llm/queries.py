"""The registered queries of this subpackage: each operator over its whole table, and its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pourscale.llm import idfile, langid, mixing, nndescent, packing, repair, secrets, simhash, superminhash, topk, toxicity, trie, vectors, warc
from pourscale.llm.common import id_crc, prepare, read
from pourscale.session import work_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind < secrets.BASE)
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text("spans").alias("spans"),
        (F.size("spans") - F.size(base)).cast("bigint").alias("n_linked"),
    )


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    files = warc.write_archives(read(spark, sf_dir, "pages"), work_folder(spark, "warc"))
    # full payloads only of the responses; a revisit's header has its payload's size and digest
    responses = warc.read_archives(files).where("record_type = 'response'").select("page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    revisits = warc.read_archives(files, payload=False).where("record_type = 'revisit'").select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return responses.unionByName(revisits)


SQL["op2_warc"] = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
     f as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) end as first from p)
select page_id, payload_bytes, payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
       case when first <> page_id then first end as refers_to from f
"""


def piece_rows(pieces: DataFrame) -> DataFrame:
    """Digest columns of packed pieces."""
    return pieces.select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return piece_rows(packing.pack(read(spark, sf_dir, "documents")))


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(read(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", "taken")


@query
def op5_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark, 4096)
    rows = vectors.usable(read(spark, sf_dir, "embeddings"))
    rows = rows.select("id", F.transform("vector", lambda x: F.floor(x * 256)).alias("vector"))
    found = topk.top_k(rows, F.col("id") % 50 == 0, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL["op5_top_inner_products"] = """
with ok as (select vec_id, min(cast(embedding as double[])) as e from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id),
     v as (select vec_id, list_transform(e, lambda x: floor(256 * x)) as e from ok),
     s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
     r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 5
"""


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = work_folder(spark, "token-files")
    idfile.write_ids(read(spark, sf_dir, "documents"), folder)
    return idfile.read_ids(spark, folder).select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark, 4096)
    found = nndescent.nearest(vectors.usable(read(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(id_crc() % 3 == 1, F.lit(False))
    weights = toxicity.fit(docs, labels.where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.scorer(spark, weights)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(id_crc() % 5 == 0, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.identify(spark, model)("text").alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))


@query
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    given = read(spark, sf_dir, "conversations")
    found, rows = repair.repair(repair.damaged(repair.whole(given)))
    hashes = repair.text_hashes(rows).withColumnRenamed("conv_id", "hashed")
    made = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("hashed")), "left").withColumnRenamed("conv_id", "of")
    every = given.select("conv_id").distinct().join(made, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    number = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in number), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query
def op12_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = superminhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL["op12_superminhash"] = r"""
with recursive w as (
       select row_number() over () as row, doc_id,
              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
     sets as (
       select row, doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
              else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
     members as (select row, len(s) as n, unnest(s) as m from sets),
     links as (
       select a.row as x, b.row as y from members a join members b on a.m = b.m and a.row <> b.row
       group by a.row, b.row, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
     reached as (select row as x, row as y from sets union select r.x, l.y from reached r join links l on l.x = r.y),
     least as (select x, min(doc_id) as component_id from reached join sets on sets.row = y group by x)
select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from sets join least on x = row
"""


#: Tables crc (crc32 of a string of ASCII characters as a step over its bytes) for the SQL twins.
_CRC = """
crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) as t
        from (select unnest(range(256)) as i))"""


def _crc(text: str) -> str:
    """SQL for the crc32 of an ASCII text, beside table crc."""
    bytes_ = f"list_transform(string_split({text}, ''), lambda x: cast(ascii(x) as bigint))"
    return f"xor(list_reduce(list_concat([4294967295], {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _edit_rows() -> str:
    """SQL values of all edits of one row in the repair: kind of row, states before and after, cost, initials, inserted lines, role set."""
    rows = []
    for kind in "xsuaoSUAO":
        extra = repair.TRUNCATED if kind.isupper() else 0
        for i, ways in repair._INSERTS.items():
            for k, n in ways.items():
                lines = "".join(("assistant:" if (i == repair.USER) == (m == 0) else "user:") + "~" for m in range(n))
                rows.append((kind, i, k, repair.INSERT * n + repair.DELETE, "I" * n + "D", lines, ""))
                if kind != "x":
                    kept = repair._NEXT[kind.lower()].get(k)
                    rows += [(kind, i, kept, repair.INSERT * n + extra, "I" * n + "K", lines, "")] if kept is not None else []
                    to = repair.ASSISTANT if k == repair.USER else repair.USER
                    rows.append((kind, i, to, repair.INSERT * n + extra + repair.RETAG, "I" * n + "R", lines, "assistant" if k == repair.USER else "user"))
    return ", ".join(map(str, rows))


SQL["op11_structure_repair"] = (
    r"""
with recursive """
    + _CRC
    + r""",
     edits(kind, i, j, cost, initials, lines, role) as (values """
    + _edit_rows()
    + r"""),
     given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                      """
    + _crc("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")
    + r""" % 20 as draw from conversations, crc),
     damaged as (
       select conv_id, turn, role as role0, md5(text) as text0, copy, case when draw = 4 then 'user' else role end as role,
              case draw when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
       from given, (values (0), (1)) as copies(copy) where draw <> 0 and (copy = 0 or draw = 3)),
     placed as (
       select *, row_number() over (partition by conv_id order by turn nulls first, role0, text0, copy) as n,
              regexp_replace(text, '[\x20\x09-\x0D]+$', '') as body from damaged),
     faults as (
       select *, case when body = '' then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate'
                      when right(body, 1) not in ('.', '!', '?') then 'truncated' end as fault,
              left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by n) as before from placed),
     kinds as (
       select *, case when fault in ('blank', 'duplicate') then 'x' when fault = 'truncated' then upper(k) else k end as kind
       from (select *, case when initial in ('s', 'u', 'a') then initial else 'o' end as k from faults)),
     steps as (
       select distinct conv_id, 0 as n, 0 as state, {'cost': 0, 'audit': '', 'out': ''} as best from kinds
       union all
       select k.conv_id, k.n, e.j, min({'cost': s.best.cost + e.cost, 'audit': s.best.audit || e.initials,
              'out': s.best.out || replace(e.lines, '~', chr(10))
                     || case right(e.initials, 1) when 'D' then '' when 'R' then e.role || ':' || k.text || chr(10) else k.role || ':' || k.text || chr(10) end})
       from steps s join kinds k on k.conv_id is not distinct from s.conv_id and k.n = s.n + 1 join edits e on e.kind = k.kind and e.i = s.state
       group by k.conv_id, k.n, e.j),
     counts as (
       select conv_id, max(n) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
              count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
              count(*) filter (where n > 1 and before || initial not in ('su', 'ua', 'au')) as illegal from kinds group by conv_id),
     done as (
       select c.*, min({'cost': s.best.cost + f.cost, 'audit': s.best.audit || f.initials, 'out': s.best.out || replace(f.lines, '~', chr(10))}) as best
       from counts c join steps s on s.conv_id is not distinct from c.conv_id and s.n = c.n
            join (values (0, 0, '', ''), (1, 10, 'II', 'user:~assistant:~'), (2, 5, 'I', 'assistant:~'), (3, 0, '', '')) as f(state, cost, initials, lines) on f.state = s.state
       group by all)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, cast(coalesce(best.cost, 0) as bigint) as cost, coalesce(best.audit, '') as audit, sha256(coalesce(left(best.out, length(best.out) - 1), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join done d on d.conv_id is not distinct from o.conv_id
"""
)


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark, 4096)
    return trie.prefix_trie(*trie.rebuilt(trie.turns_of(read(spark, sf_dir, "conversations"))))


SQL["op13_prefix_trie"] = (
    r"""
with """
    + _CRC
    + r""",
     given as (
       select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                            order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as own
       from conversations where conv_id is not null group by conv_id),
     drawn as (select conv_id, own, """
    + _crc("cast(conv_id as varchar)")
    + r""" % 6 as h from given, crc),
     made as (select c.conv_id, list_concat(coalesce(b.own, [])[1:h], c.own[h + 1:]) as turns from drawn c left join given b on b.conv_id = c.conv_id - c.conv_id % 100),
     steps as (select conv_id, len(turns) as n, unnest(range(len(turns) + 1)) as depth, turns from made),
     prefixes as (select conv_id, n, depth, turns[1:depth] as prefix, turns[1:depth - 1] as parent, coalesce(length(turns[depth].text), 0) as size from steps),
     nodes as (
       select depth, prefix, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
              coalesce(string_agg(conv_id, ',' order by conv_id) filter (where n = depth), '') as ending from prefixes group by depth, prefix),
     children as (select depth - 1 as depth, parent as prefix, count(*) as n_children from nodes where depth > 0 group by depth, parent),
     counted as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (depth, prefix)),
     above as (select unnest(range(depth + 1)) as depth, prefix, n_children = 0 as leaf, (n_convs - 1) * size as saved from counted),
     sums as (select depth, prefix[1:depth] as prefix, count(*) filter (where leaf) as n_leaves, sum(saved) as saved from above group by all)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, n_leaves, cast(saved as bigint) as saved_tokens, sha256(c.ending) as ends_sha256
from counted c join sums s on s.depth = c.depth and s.prefix = c.prefix left join nodes p on c.depth > 0 and p.depth = c.depth - 1 and p.prefix = c.parent
"""
)
