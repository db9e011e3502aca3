"""One query per operator of the catalog engine, with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes, content, paths, times, units
from ..operators import dedup, keyed, links, lookup, reports, restore, scan, sparse
from ..operators import transitions as tr
from ..operators.offsets import with_offsets
from ..operators.predicates import archivable, changed_since, in_phase, selected, sparsify_candidate
from ..schema import flag_names, has, with_flag, without_flag
from . import fixtures

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Register a function under its name, with its oracle; ``FILES`` in it stands for the catalog."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.replace("FILES", fixtures.FILES)
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


# -- content, paths, units ------------------------------------------------------------------------


@query("select doc_id id, cast(strlen(text) as bigint) size, min(doc_id) over (partition by sha1(text), strlen(text), text) canonical_id, doc_id = min(doc_id) over (partition by sha1(text), strlen(text), text) is_canonical from documents where text is not null")
def canonical_election(spark, d):
    """Which copy of each content is kept; equal digests and sizes are verified by content."""
    rows = _docs(spark, d).where("text is not null").select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("content"))
    elected = dedup.elect(rows, ("sha1", "size", "content"), keep=("size",))
    return elected.select("id", "size", "canonical_id", (F.col("id") == F.col("canonical_id")).alias("is_canonical"))


@query("with FILES select id, rel_path, ext, size, sha1, ftype, uid, gid, mode, sparse_count, canonical_id, phase, flags from files")
def inventory(spark, d):
    return fixtures.files(spark, d).select("id", "rel_path", "ext", "size", "sha1", "ftype", "uid", "gid", "mode", "sparse_count", "canonical_id", "phase", "flags")


@query(r"with FILES select id, regexp_extract(regexp_replace(rel_path, '^.*/', ''), '^.+(\.[^.]+)$', 1) ext, regexp_replace(rel_path, '^.*/', '') base, regexp_replace(rel_path, '/[^/]*$', '') up from files")
def ext_of_path(spark, d):
    p = F.col("rel_path")
    return fixtures.files(spark, d).select("id", paths.extension(p).alias("ext"), paths.basename(p).alias("base"), paths.parent(p).alias("up"))


_ENDS = [".tar.xz", ".TXZ", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tbz", ".tar.zst", ".tzst", ".tar", ".zip"]
_LIST = "[" + ", ".join(f"'{e}'" for e in _ENDS) + "]"


@query(f"""with FILES, p as (select id, 'b' || id || ({_LIST})[id % 11 + 1] name, case id % 3 when 0 then '/' when 1 then '' else '/data/x/' end up, id % 11 k from files)
select id, up || name path, (['xz', 'xz', 'gzip', 'gzip', 'bzip2', 'bzip2', 'bzip2', 'zstd', 'zstd', 'none', 'none'])[k + 1] format, 'b' || id stem, case id % 3 when 0 then '/' when 1 then '.' else '/data/x' end parent,
case id % 3 when 0 then '/' when 1 then './' else '/data/x/' end || 'b' || id || '.astage' work from p""")
def archive_paths(spark, d):
    ends = F.array(*map(F.lit, _ENDS))
    up = F.when(F.col("id") % 3 == 0, "/").when(F.col("id") % 3 == 1, "").otherwise("/data/x/")
    p = fixtures.raw_files(spark, d).select("id", F.concat(up, F.lit("b"), F.col("id").cast("string"), F.get(ends, (F.col("id") % 11).cast("int"))).alias("path"))
    c = F.col("path")
    return p.select("id", "path", paths.compression(c).alias("format"), paths.archive_stem(c).alias("stem"), paths.parent(c).alias("parent"), paths.work_dir(c).alias("work"))


@query("""with FILES, p as (select id, (['a/./b/../c', '/../x//y/', '../../z', './', 'a/b/../../..', '/'])[id % 6 + 1] path from files)
select id, (['a/c', '/x/y', '../../z', '.', '..', '/'])[id % 6 + 1] cleaned, (['d/e/a/c', '/x/y', 'z', 'd/e', 'd', '/'])[id % 6 + 1] resolved, id % 6 = 3 safe from p""")
def clean_paths(spark, d):
    forms = F.array(*map(F.lit, ["a/./b/../c", "/../x//y/", "../../z", "./", "a/b/../../..", "/"]))
    p = fixtures.raw_files(spark, d).select("id", F.get(forms, (F.col("id") % 6).cast("int")).alias("path"))
    return p.select("id", paths.clean(F.col("path")).alias("cleaned"), paths.resolve(F.lit("d/e/link"), F.col("path")).alias("resolved"), paths.is_safe(F.col("path")).alias("safe"))


_LE = "array_to_string(list_transform([7, 6, 5, 4, 3, 2, 1, 0], lambda i: substr(lpad(hex({0}), 16, '0'), 2 * i + 1, 2)), '')"
_B64 = "translate(rtrim(to_base64(unhex({0})), '='), '+/', '-_')"
_CID = f"{_B64.format('sha1')} || '.' || {_B64.format(_LE.format('size'))} || '.' || {_B64.format(_LE.format('id'))} || ext"


@query(f"with FILES select id, case when canonical_id = id and ftype = 'file' then {_CID} end content_id, case when canonical_id = id and ftype = 'file' then case when flags & 4 <> 0 then 'sp.' else '' end || {_CID} end member from files")
def content_id(spark, d):
    return fixtures.files(spark, d).select("id", content.content_id().alias("content_id"), content.member_name().alias("member"))


@query("with FILES select id, sha1, size, ext, flags & 4 <> 0 sparse from files where canonical_id = id and ftype = 'file'")
def content_id_parse(spark, d):
    named = fixtures.files(spark, d).select(content.member_name().alias("member")).where("member is not null")
    return named.select(content.parse(F.col("member")).alias("p")).select("p.id", "p.sha1", "p.size", "p.ext", "p.sparse")


@query("""with FILES, t as (select id, (['4096', '1Kb', '1Kib', ' 1Mb', '1Mib', '1Gib', '2.5Kib', 'x1', '3 kb', ''])[id % 10 + 1] s, cast(id as varchar) || (['', 'K', 'M', 'G', 'KiB', 'MiB', 'GiB', '%', ' T', '-'])[id % 10 + 1] l from files)
select id, ([4096, 1000, 1024, 1000000, 1048576, 1073741824, 2560, null, 3000, null])[id % 10 + 1] size,
case when id % 10 = 7 then case when id between 1 and 100 then id * 8000000000 // 100 end else id * ([1, 1000, 1000000, 1000000000, 1024, 1048576, 1073741824, null, null, null])[id % 10 + 1] end limit_bytes from t""")
def parse_sizes(spark, d):
    sizes = F.array(*map(F.lit, ["4096", "1Kb", "1Kib", " 1Mb", "1Mib", "1Gib", "2.5Kib", "x1", "3 kb", ""]))
    ends = F.array(*map(F.lit, ["", "K", "M", "G", "KiB", "MiB", "GiB", "%", " T", "-"]))
    k = (F.col("id") % 10).cast("int")
    rows = fixtures.raw_files(spark, d).select("id", F.get(sizes, k).alias("s"), F.concat(F.col("id").cast("string"), F.get(ends, k)).alias("l"))
    return rows.select("id", units.parse_size(F.col("s")).alias("size"), units.parse_limit(F.col("l"), F.lit(8_000_000_000)).alias("limit_bytes"))


@query("""with FILES, t as (select id, size * (id % 9) * (id % 9) * (id % 9) * (id % 9) * (id % 9) n, rel_path, id * 7 s from files)
select id, case when n >= 1073741824 then printf('%.2f', n / 1073741824.0) || 'GiB' when n >= 1048576 then printf('%.2f', n / 1048576.0) || 'MiB' when n >= 1024 then printf('%.2f', n / 1024.0) || 'KiB' else n || 'B' end bytes,
case when s < 60 then s || ' seconds' when s < 3600 then (s // 60) || 'min' || lpad(cast(s % 60 as varchar), 2, '0') || 's' else (s // 3600) || 'h' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || 'min' || lpad(cast(s % 60 as varchar), 2, '0') || 's' end duration,
replace(format('{:,}', (n + 1048575) // 1048576), ',', '''') || ' MiB' mib, case when length(rel_path) <= 13 then rel_path else left(rel_path, 6) || '…' || right(rel_path, 6) end short from t""")
def format_units(spark, d):
    k = F.col("id") % 9
    rows = fixtures.raw_files(spark, d).select("id", (F.col("size") * k * k * k * k * k).alias("n"), "rel_path", (F.col("id") * 7).alias("s"))
    return rows.select("id", units.format_bytes(F.col("n")).alias("bytes"), units.format_duration(F.col("s")).alias("duration"), units.format_mib(F.col("n")).alias("mib"), units.truncate_middle(F.col("rel_path"), 13).alias("short"))


@query("select event_id, event_type attribute, cast(user_id as varchar) value, cast(user_id % 8 as integer) perm, user_id owner from events")
def attribute_json(spark, d):
    """Attributes and access lists written as JSON and read back."""
    e = spark.read.parquet(f"{d}/events.parquet")
    stored = e.select("event_id", attributes.dump_xattrs(F.create_map("event_type", F.col("user_id").cast("string"))).alias("x"), F.to_json(F.create_map(F.concat(F.lit("user:"), F.col("user_id").cast("string")), (F.col("user_id") % 8).cast("int"))).alias("a"))
    read = stored.select("event_id", attributes.xattrs(F.col("x")).alias("attrs"), attributes.acl_entries(F.col("a"))[0].alias("e"))
    return read.select("event_id", F.map_keys("attrs")[0].alias("attribute"), F.map_values("attrs")[0].alias("value"), F.col("e.permissions").alias("perm"), F.col("e.identifier").alias("owner"))


# -- flags and updates ----------------------------------------------------------------------------


@query("""with FILES select id, flags & 64 <> 0 appended, flags | 4 sparse, flags & ~1 cleared, array_to_string(list_filter([case when flags & 1 <> 0 then 'extracted' end, case when flags & 4 <> 0 then 'has_sparse' end, case when flags & 8 <> 0 then 'checked' end, case when flags & 16 <> 0 then 'dedup_error' end, case when flags & 64 <> 0 then 'appended' end], lambda x: x is not null), ',') names from files""")
def flag_mask(spark, d):
    f = F.col("flags")
    return fixtures.raw_files(spark, d).select("id", has(f, "appended").alias("appended"), with_flag(f, "has_sparse").alias("sparse"), without_flag(f, "extracted").alias("cleared"), F.array_join(flag_names(f), ",").alias("names"))


def _state(files: DataFrame) -> DataFrame:
    return files.select("id", "phase", "flags", "canonical_id")


@query("""with FILES, g as (select sha1, size, count(*) n from files where sha1 is not null group by 1, 2)
select id, case when phase <> 'filtered' then phase when ftype is null or ftype <> 'file' or sha1 is null then 'deduped' when exists (select 1 from g where g.sha1 = files.sha1 and g.size = files.size and n = 1) then 'deduped' else 'filtered' end phase from files""")
def bulk_skips(spark, d):
    f = tr.skip_missing_digests(tr.skip_non_files(fixtures.files(spark, d)))
    alone = reports.singletons(f).select("id", F.lit(None).cast("long").alias("canonical_id"))
    return tr.set_canonical(f, alone).select("id", "phase")


@query("""with FILES select id, 'deduped' phase, case when ftype = 'file' and sha1 is not null then min(id) over (partition by sha1, size, coalesce(ftype = 'file', false)) end canonical_id from raw""")
def dedup_step(spark, d):
    """The whole deduplication step on a catalog in which every row is filtered."""
    f = tr.update(fixtures.files(spark, d), F.lit(True), phase="filtered", canonical_id=None)
    return dedup.dedup(f).select("id", "phase", "canonical_id")


@query("""with FILES, c as (select *, coalesce(canonical_id = id and ftype = 'file' and sha1 is not null and sparse_count >= 2 and flags & 4 = 0, false) cand from files)
select id, cand candidate, case when phase = 'deduped' and not cand then 'sparsified' else phase end phase from c""")
def sparsify_candidates(spark, d):
    f = fixtures.files(spark, d)
    marked = f.select("id", sparsify_candidate(2).alias("candidate"))
    return marked.join(tr.skip_sparsify(f, 2).select("id", "phase"), "id")


@query("""with FILES select id, case when phase = 'deduped' and id % 2 = 0 then 'sparsified' else phase end phase, case when phase = 'deduped' and id % 2 = 0 then case when id % 4 = 0 then flags | 4 else flags | 32 end else flags end flags from files""")
def sparsify_outcomes(spark, d):
    f = fixtures.files(spark, d)
    out = f.where("phase = 'deduped' and id % 2 = 0").select("id", (F.col("id") % 4 == 0).alias("ok"))
    return tr.set_sparsified(f, out).select("id", "phase", "flags")


@query("""with FILES select id, coalesce(canonical_id = id and ftype = 'file' and sha1 is not null, false) payload, case when phase = 'staged' and not coalesce(canonical_id = id and ftype = 'file' and sha1 is not null, false) then 'archived' else phase end phase from files""")
def archive_eligible(spark, d):
    f = fixtures.files(spark, d)
    return f.select("id", archivable().alias("payload")).join(tr.archive_ineligible(f).select("id", "phase"), "id")


@query("""with FILES select id, case when phase = 'filtered' and flags & 16 <> 0 and canonical_id is null then 'deduped' else phase end phase from files""")
def errored_pending(spark, d):
    return tr.promote_errored(fixtures.files(spark, d)).select("id", "phase")


@query("""with FILES select id, 'archived' phase, flags | case when id % 10 = 0 then 64 else 0 end flags from files where flags | case when id % 10 = 0 then 64 else 0 end >= 64 union all
select id, phase, flags from files where not (flags | case when id % 10 = 0 then 64 else 0 end >= 64)""")
def session_members(spark, d):
    """Members written in a session become appended, and archived with its end."""
    f = fixtures.files(spark, d)
    return tr.archive_appended(tr.mark_appended(f, f.where("id % 10 = 0").select("id"))).select("id", "phase", "flags")


@query("""with FILES select id, case when phase = 'archived' or flags & 64 <> 0 then 'staged' else phase end phase, case when flags & 64 <> 0 then flags - 64 else flags end flags, case when flags & 64 <> 0 and phase <> 'archived' then flags - 64 else flags end recovered from files""")
def reset_archive(spark, d):
    f = fixtures.files(spark, d)
    back = tr.clear_pending(f).select("id", F.col("flags").alias("recovered"))
    return tr.reset_archive(f).select("id", "phase", "flags").join(back, "id")


@query("with FILES select id, 'archived' phase, flags & ~1 flags from files")
def normalise_installed(spark, d):
    return tr.normalise_installed(fixtures.files(spark, d)).select("id", "phase", "flags")


_DONE = "(flags & 1 <> 0 or canonical_id in (select id from files where flags & 1 <> 0))"


@query(f"""with FILES, p as (select *, phase = 'archived' and {_DONE} and id % 4 <> 0 hit from files), u as (select id from p where hit)
select id, case when hit or (phase = 'archived' and canonical_id in (select id from u)) then 'unarchived' else phase end phase from p""")
def snapshot_confirm(spark, d):
    """Confirmation by a snapshot that lists three of four paths; copies follow their canonical."""
    f = fixtures.files(spark, d)
    snapshot = f.where("id % 4 <> 0").select("rel_path", F.lit("archived").alias("phase"))
    return tr.confirm_snapshot(f, snapshot)[0].select("id", "phase")


@query(f"with FILES select id, case when phase = 'archived' and {_DONE} then 'unarchived' else phase end phase from files")
def salvage_promote(spark, d):
    return tr.salvage(fixtures.files(spark, d)).select("id", "phase")


@query("""with FILES, f as (select *, case when phase = 'archived' then 'unarchived' else phase end p from files),
r as (select id, case when id % 17 = 1 then null when id % 10 = 0 then sha1('x' || cast(id as varchar)) else sha1 end h from f where canonical_id = id)
select f.id, case when p = 'unarchived' and r.id is not null then 'rehashed' else p end phase, flags | case when p <> 'unarchived' or r.id is null then 0 when h is null then 512 when h <> f.sha1 then 256 else 0 end flags from f left join r on r.id = coalesce(canonical_id, f.id)""")
def rehash_mismatch(spark, d):
    """Digests of payloads taken again, some damaged, some unreadable."""
    f = tr.update(fixtures.files(spark, d), in_phase("archived"), phase="unarchived")
    h = F.when(F.col("id") % 17 == 1, None).when(F.col("id") % 10 == 0, F.sha1(F.concat(F.lit("x"), F.col("id").cast("string")))).otherwise(F.col("sha1"))
    return tr.verify_rehash(f, f.where("canonical_id = id").select("id", h.alias("sha1"))).select("id", "phase", "flags")


@query("""with FILES, u as (select n_nationkey uid, n_name name from nation), g as (select r_regionkey gid, r_name name from region)
select id, u.name username, g.name groupname from files left join u using (uid) left join g using (gid)""")
def name_lookup(spark, d):
    users = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("uid"), F.col("n_name").alias("name"))
    groups = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("long").alias("gid"), F.col("r_name").alias("name"))
    return tr.fill_names(fixtures.files(spark, d), users, groups).select("id", "username", "groupname")


@query(r"""with FILES select id, case when phase = 'sparsified' then case when regexp_matches(rel_path, '(^|/)en/') and not regexp_matches(rel_path, 'doc[^/]*[13]\.txt$') then 'filtered' else 'archived' end else phase end phase,
case when phase = 'sparsified' and not (regexp_matches(rel_path, '(^|/)en/') and not regexp_matches(rel_path, 'doc[^/]*[13]\.txt$')) then 1 end exclusion_id from files""")
def filter_patterns(spark, d):
    f = tr.update(fixtures.files(spark, d), in_phase("sparsified"), phase="hashed")
    return tr.apply_filter(f, ["en"], ["doc*[13].txt"]).select("id", "phase", "exclusion_id")


@query(r"with FILES select id from files where regexp_matches(rel_path, '^(.*/)?doc[^/]\.md$') or regexp_matches(rel_path, '^src1/.*[05]$')")
def select_paths(spark, d):
    f = fixtures.files(spark, d)
    return f.where(selected(["doc?.md", "src1/**[05]"])).select("id")


@query("""with e as (select event_id, user_id, ts a, case when event_id % 5 = 0 then null when event_id % 3 = 0 then ts + interval 2 second else date_trunc('second', ts) end b from events)
select event_id, coalesce(date_trunc('second', a) <> date_trunc('second', b), false) changed from e""")
def changed_since_inventory(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    b = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("interval 2 second")).otherwise(F.date_trunc("second", "ts"))
    times = lambda m: F.struct(m.alias("mtime"), F.col("ts").alias("atime"), F.lit(None).cast("timestamp").alias("ctime"))
    return e.select("event_id", times(F.col("ts")).alias("stored"), times(b).alias("current")).select("event_id", changed_since().alias("changed"))


# -- keyed writes and sessions --------------------------------------------------------------------


@query("""with e as (select * from (select event_id id, event_type || '/' || cast(user_id % 50 as varchar) rel_path from events) where id % 2 = 0), n as (select rel_path, min(id) id from (select event_id id, event_type || '/' || cast(user_id % 90 as varchar) rel_path from events where event_id % 2 = 1) group by 1)
select id, rel_path, true old from e union all select id, rel_path, false from n where rel_path not in (select rel_path from e)""")
def insert_or_ignore(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    path = lambda n: F.concat("event_type", F.lit("/"), (F.col("user_id") % n).cast("string"))
    old = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), path(50).alias("rel_path"))
    new = e.where("event_id % 2 = 1").select(F.col("event_id").alias("id"), path(90).alias("rel_path"))
    _, inserted = keyed.insert_or_ignore(old, new)
    return old.withColumn("old", F.lit(True)).unionByName(inserted.withColumn("old", F.lit(False)))


@query("""with o as (select cast(c_custkey as varchar) key, c_name value from customer), n as (select cast(c_custkey * 2 as varchar) key, c_mktsegment value from customer)
select * from (select * from o where key not in (select key from n) union all select * from n) where key not in (select cast(s_suppkey as varchar) from supplier)""")
def meta_store(spark, d):
    """Upsert, then delete, by key."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    old = c.select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"))
    new = c.select((F.col("c_custkey") * 2).cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    gone = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("key"))
    return keyed.delete(keyed.upsert(old, new), gone)


@query("select o_orderkey id, cast(floor(o_totalprice) as bigint) archive_offset from orders where o_orderstatus = 'O' order by o_orderkey desc limit 1")
def latest_open_session(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    sessions = o.select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("archive_offset"), F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("finalized"))
    return reports.latest_open_session(sessions).select("id", "archive_offset")


# -- aggregates -----------------------------------------------------------------------------------


@query("with FILES select phase, count(*) n from files group by 1")
def phase_counts(spark, d):
    return reports.phase_counts(fixtures.raw_files(spark, d))


@query("with FILES select sha1, size, count(*) n, cast(sum(case when phase = 'filtered' then 1 else 0 end) as bigint) waiting from files where sha1 is not null group by 1, 2 having count(*) > 1 and sum(case when phase = 'filtered' then 1 else 0 end) > 0")
def duplicate_groups(spark, d):
    return reports.pending_groups(fixtures.raw_files(spark, d))


@query("with FILES select id from files where phase = 'filtered' and (sha1, size) in (select (sha1, size) from files where sha1 is not null group by sha1, size having count(*) = 1)")
def singleton_files(spark, d):
    return reports.singletons(fixtures.raw_files(spark, d)).select("id")


@query("with FILES select cast(coalesce(sum(case when phase in ('staged', 'archived') then size end), 0) as bigint) to_archive, cast(coalesce(sum(case when phase = 'archived' then size end), 0) as bigint) archived from files where canonical_id = id and ftype = 'file' and sha1 is not null")
def canonical_bytes(spark, d):
    return reports.canonical_bytes(fixtures.files(spark, d))


@query("with FILES select count(*) n_rows, count(*) filter (where canonical_id <> id) n_copies, cast(coalesce(sum(size), 0) as bigint) n_bytes, cast(coalesce(sum(case when canonical_id <> id then size end), 0) as bigint) saved from files")
def bytes_saved(spark, d):
    return reports.bytes_saved(fixtures.files(spark, d))


@query(f"""with FILES, e as (select *, {_DONE} done from files)
select count(*) filter (where canonical_id = id and flags & 64 <> 0 and flags & 1 = 0) missing, count(*) filter (where phase = 'archived' and done) unconfirmed, count(*) filter (where canonical_id = id and flags & 1 <> 0) extracted_canonical, count(*) filter (where done) extracted_paths, count(*) filter (where phase = 'unarchived') confirmed from e""")
def extraction_counts(spark, d):
    return reports.extraction_counts(fixtures.files(spark, d))


@query("with FILES select coalesce(ftype, 'null') ftype, count(*) n from files where flags & 64 = 0 group by 1")
def non_appended_by_ftype(spark, d):
    return reports.non_appended_by_type(fixtures.raw_files(spark, d))


@query("with FILES select count(*) filter (where phase = 'filtered' and canonical_id = id) active, count(*) filter (where phase = 'filtered' and canonical_id is null and flags & 16 = 0) electable, count(*) filter (where flags & 8 <> 0) checked from files")
def dedup_progress(spark, d):
    return reports.dedup_progress(fixtures.files(spark, d))


@query("with FILES select distinct 'user' kind, uid number from files where uid is not null union all select distinct 'group', gid from files where gid is not null")
def distinct_owners(spark, d):
    return reports.distinct_owners(fixtures.raw_files(spark, d))


# -- bytes ----------------------------------------------------------------------------------------


@query("""with c as (select doc_id id, hex(encode(coalesce(text, ''))) || repeat('00', doc_id % 100) h from documents), s as (select id, h, len(h) // 2 n from c)
select id, sha1(unhex(h)) sha1, n size, cast(len(list_filter(range(0, n // 16), lambda i: substr(h, 32 * i + 1, 32) = repeat('00', 16))) as bigint) sparse_count from s""")
def zero_page_count(spark, d):
    """Empty pages of 16 bytes, with the digest, in one pass over each content."""
    return sparse.inspect_content(fixtures.contents(spark, d), 16).select("id", "sha1", "size", "sparse_count")


@query("""with c as (select doc_id id, hex(encode(coalesce(text, ''))) || repeat('00', doc_id % 100) h from documents)
select id, cast(len(list_filter(range(0, len(h) // 32), lambda i: substr(h, 32 * i + 1, 32) = repeat('00', 16))) as bigint) pages from c""")
def zero_pages_plain(spark, d):
    """The same count with DataFrame functions only."""
    return fixtures.contents(spark, d).select("id", sparse.zero_pages(F.col("content"), 16).alias("pages"))


@query("""with c as (select page_id id, hex(encode(html)) || repeat('00', page_id % 700) h from pages), s as (select id, h, len(h) // 2 n from c),
z as (select *, len(list_filter(range(0, n // 64), lambda i: substr(h, 128 * i + 1, 128) = repeat('00', 64))) k from s)
select id, n size, cast(k as bigint) zero_pages, cast(k * 64 + case when n % 64 > 0 and substr(h, 128 * (n // 64) + 1) = repeat('00', n % 64) then n % 64 else 0 end as bigint) bytes_saved from z""")
def page_sparse_stats(spark, d):
    """What a sparse copy of each page would leave out; a zero tail saves bytes but is no page."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    c = p.select(F.col("page_id").alias("id"), F.unhex(F.concat(F.hex(F.col("html").cast("binary")), F.expr("repeat('00', cast(page_id % 700 as int))"))).alias("content"))
    return sparse.inspect_content(c, 64).select("id", "size", F.col("sparse_count").alias("zero_pages"), "bytes_saved")


# -- dedup by rounds ------------------------------------------------------------------------------

_WEAK = "substr(sha1(coalesce(text, '')), 1, 2) sha1, cast(strlen(coalesce(text, '')) // 200 as bigint) size"


def _weak(spark, d):
    """Rows under a key so weak that different contents share it."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return _docs(spark, d).select(F.col("doc_id").alias("id"), F.substring(F.sha1(t), 1, 2).alias("sha1"), F.floor(F.octet_length(t) / 200).cast("long").alias("size"), F.sha2(t, 256).alias("content"))


@query(f"with w as (select doc_id id, {_WEAK}, coalesce(text, '') t from documents) select sha1, size, count(*) n, count(distinct t) n_contents from w group by 1, 2 having count(*) > 1")
def weak_key_rounds(spark, d):
    return dedup.content_groups(_weak(spark, d))


@query(f"with w as (select doc_id id, {_WEAK}, coalesce(text, '') t from documents) select id, min(id) over (partition by sha1, size, t) canonical_id, false error from w")
def round_election(spark, d):
    """Election by rounds of comparisons, none of which fails: the same as the grouped minimum."""
    none = spark.createDataFrame([], "canonical long, candidate long, side long")
    return dedup.elect_with_errors(_weak(spark, d), none)


# -- order, links, members, restore ---------------------------------------------------------------


@query("with FILES select id, row_number() over (order by ext, size, id) as position, cast(coalesce(sum(size) over (order by ext, size, id rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from files where phase = 'staged' and canonical_id = id and ftype = 'file' and sha1 is not null")
def packing_order(spark, d):
    rows = reports.packing_order(fixtures.files(spark, d)).select("id", "ext", "size")
    return with_offsets(rows, ["ext", "size", "id"]).select("id", "position", "offset")


@query("""with recursive n as (select n_nationkey node, case when n_nationkey = 21 then 23 when n_nationkey = 22 then 99 when n_nationkey % 5 = 0 then null else n_nationkey - 1 end target from nation),
w as (select node, node cur, target nxt, 0 hops from n union all select w.node, w.nxt, n.target, hops + 1 from w left join n on n.node = w.nxt where w.nxt is not null and hops < 40)
select node, case when max(hops) >= 40 then null else max_by(cur, hops) end as \"last\", case when max(hops) >= 40 then null else cast(max(hops) as bigint) end hops, case when max(hops) >= 40 then 'cycle' when max_by(cur, hops) in (select node from n) then 'end' else 'dangling' end kind from w group by 1""")
def link_closure(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey")
    return links.resolve_links(n.select(k.alias("node"), F.when(k == 21, 23).when(k == 22, 99).when(k % 5 == 0, None).otherwise(k - 1).alias("target")))


@query(f"""with FILES, m as (select id member_index, {_CID} name, id from files where canonical_id = id and id % 50 <> 0 union all select doc_id, 'snapshot.sqlite', null from documents where doc_id % 50 = 0)
select p.id payload_id, p.member_index, (select min(s.member_index) from m s where s.id is null and s.member_index > p.member_index) snapshot_index from m p where p.id is not null""")
def snapshot_of_member(spark, d):
    """The snapshot that confirms each payload member: the next one in the stream."""
    f = fixtures.files(spark, d)
    payload = f.where("canonical_id = id and id % 50 <> 0").select(F.col("id").alias("member_index"), content.content_id().alias("name"))
    marks = f.where("id % 50 = 0").select(F.col("id").alias("member_index"), F.lit("./snapshot.sqlite").alias("name"))
    return scan.confirmations(payload.unionByName(marks))


@query("""select event_id, case when not m and not s and not f then case when r then 'resumed without provenance' end when not m and not s then 'footer without snapshot' when not m and s and not f then 'snapshots without manifest or footer' when not m then 'footer and snapshots without manifest' when not s and not f then 'manifest without snapshot' when not s then 'manifest and footer without snapshot' when f then 'complete with footer' else 'complete' end outcome
from (select event_id, event_id % 2 = 0 m, event_id % 3 > 0 s, event_id % 5 = 0 f, event_id % 7 < 3 r from events)""")
def scan_outcome(spark, d):
    e, k = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    return e.select("event_id", scan.outcome_column(k % 2 == 0, k % 3, k % 5 == 0, k % 7 < 3).alias("outcome"))


@query(f"""with FILES, k as (select id c, case when flags & 4 <> 0 then 'sp.' else '' end || {_CID} member from files where canonical_id = id and ftype = 'file')
select id, rel_path, canonical_id, member, size, not starts_with(rel_path, '/') and not list_contains(string_split(rel_path, '/'), '..') safe from files join k on canonical_id = c where phase = 'archived' and ftype = 'file'""")
def restore_plan(spark, d):
    return restore.restore_plan(fixtures.files(spark, d), ("archived",)).select("id", "rel_path", "canonical_id", "member", "size", "safe")


@query(f"""with FILES, k as (select *, case when flags & 4 <> 0 then 'sp.' else '' end || {_CID} member from files where canonical_id = id and ftype = 'file' and sha1 is not null)
select id, member, case when flags & 4 <> 0 then '/work/sparse/' || member else '/data/' || rel_path end source from k""")
def stage_plan(spark, d):
    return restore.stage_plan(fixtures.files(spark, d), "/data", "/work/sparse").select("id", "member", "source")


# -- plain reads, single updates, sums ------------------------------------------------------------


@query("with FILES select id, rel_path, ext, size, sha1, ftype, canonical_id, phase, flags, row_number() over (order by id) as position from files where phase = 'staged'")
def phase_in_order(spark, d):
    """A phase's narrow rows in the order of ids, with the place of each."""
    rows = lookup.in_order(fixtures.files(spark, d), "staged").drop("mtime", "atime", "ctime")
    return with_offsets(rows, ["id"]).drop("offset")


@query("with FILES select id, rel_path, phase from files where id in (7, 31, 100)")
def point_lookup(spark, d):
    f = fixtures.files(spark, d)
    found = [lookup.by_id(f, i).select("id", "rel_path", "phase") for i in (7, 31, 100)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("with FILES select count(*) n, count(*) filter (where phase = 'staged') staged from files")
def row_counts(spark, d):
    f = fixtures.files(spark, d)
    return spark.range(1).select(F.lit(lookup.count(f)).cast("long").alias("n"), F.lit(lookup.count(f, "staged")).cast("long").alias("staged"))


@query("with FILES select id, case when id = 12 then 'archived' else phase end phase, case when id = 13 then flags | 8 when id = 14 then flags & ~64 else flags end flags from files")
def single_updates(spark, d):
    f = tr.mark_phase(fixtures.files(spark, d), 12, "archived")
    return tr.clear_flag(tr.set_flag(f, 13, "checked"), 14, "appended").select("id", "phase", "flags")


@query("""with FILES select id, case when id % 3 = 0 then sha1('n' || cast(id as varchar)) else sha1 end sha1, case when id % 3 = 0 then id % 4 else sparse_count end sparse_count, case when id % 3 = 0 then 'hashed' else phase end phase from files""")
def set_inspection(spark, d):
    """Digests and zero pages of inspected rows replace what the catalog had."""
    f = fixtures.files(spark, d)
    found = f.where("id % 3 = 0").select("id", F.sha1(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("sha1"), (F.col("id") % 4).alias("sparse_count"))
    return tr.set_inspection(f, found).select("id", "sha1", "sparse_count", "phase")


@query("with FILES select id, 'archived' phase, case when phase = 'archived' then 0 else 1 end moved from files")
def archive_remainder(spark, d):
    f = fixtures.files(spark, d)
    was = f.select("id", F.when(F.col("phase") == "archived", 0).otherwise(1).alias("moved"))
    return tr.archive_remainder(f).select("id", "phase").join(was, "id")


@query("with FILES select id, case when id % 4 = 1 then flags | 1 else flags end flags from files")
def mark_extracted(spark, d):
    f = fixtures.files(spark, d)
    return tr.mark_extracted(f, f.where("id % 4 = 1").select("id")).select("id", "flags")


@query("with FILES select id, case when phase = 'filtered' and flags & 8 <> 0 then flags - 8 else flags end flags, case when phase = 'filtered' and canonical_id = id then 'deduped' else phase end phase from files")
def end_of_round(spark, d):
    """After a round the checked flags go and active canonicals are settled."""
    return tr.promote_active_canonicals(tr.clear_checked(fixtures.files(spark, d))).select("id", "flags", "phase")


@query("with FILES select sha1, size, count(*) n from files where phase = 'filtered' and canonical_id is not null group by 1, 2 having count(*) > 1")
def crowded_canonicals(spark, d):
    """Groups in which several filtered rows are their own canonical: there should be none, here there are."""
    f = fixtures.files(spark, d)
    return tr.crowded_canonicals(tr.update(f, F.col("canonical_id").isNotNull(), canonical_id=F.col("id")))


@query("with FILES select cast(coalesce(sum(size), 0) as bigint) n_bytes from files where phase = 'archived'")
def bytes_to_restore(spark, d):
    return reports.bytes_to_restore(tr.update(fixtures.files(spark, d), in_phase("archived"), phase="unarchived"))


@query("with FILES select count(*) filter (where id % 3 > 0) ok, count(*) filter (where id % 3 = 0) failed from files where phase = 'deduped'")
def sparsify_tally(spark, d):
    f = fixtures.files(spark, d)
    return reports.sparsify_tally(f.where("phase = 'deduped'").select("id", (F.col("id") % 3 > 0).alias("ok")))


_SESSION = "select o_orderkey id, cast(floor(o_totalprice) as bigint) archive_offset, case o_orderstatus when 'O' then 0 when 'F' then 1 else 2 end finalized from orders"


def _sessions(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    state = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    return o.select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("archive_offset"), state.alias("finalized"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))


@query(f"with s as ({_SESSION}) select id, archive_offset, finalized, false closed from s union all select max(id) + 1, 4096, 1, true from s")
def session_begin_finalize(spark, d):
    """A session is appended to the log, and its end closes it alone."""
    s = _sessions(spark, d)
    begun = keyed.begin_session(s, 4096)
    number = s.agg(F.max("id")).first()[0] + 1
    return keyed.finalize_session(begun, number).select("id", "archive_offset", "finalized", F.col("finished_at").isNotNull().alias("closed"))


@query(f"with FILES, s as ({_SESSION}), o as (select id, archive_offset from s where finalized = 0 order by id desc limit 1) select 'session' what, s.id, case when s.id = (select id from o) then 2 else finalized end state, (select archive_offset from o) cut from s union all select 'file', id, case when flags & 64 <> 0 and phase <> 'archived' then flags - 64 else flags end, (select archive_offset from o) from files")
def session_recover(spark, d):
    """After a crash the latest open session is aborted, its unconfirmed members are pending, and the file is cut."""
    sessions, files, cut = keyed.recover(_sessions(spark, d), fixtures.files(spark, d))
    rows = sessions.select(F.lit("session").alias("what"), "id", F.col("finalized").cast("long").alias("state"))
    return rows.unionByName(files.select(F.lit("file").alias("what"), "id", F.col("flags").alias("state"))).withColumn("cut", F.lit(cut).cast("long"))


@query("with FILES select id, rel_path from files where ftype = 'file' and (phase <> 'archived' or sha1 is null)")
def unrestored_files(spark, d):
    """Regular files of a catalog that no payload of the archive restores."""
    f = tr.update(fixtures.files(spark, d), in_phase("archived"), phase="unarchived")
    return restore.unrestored(f).select("id", "rel_path")


@query(r"with FILES select id, case when starts_with(rel_path, 'src1/') then regexp_replace(rel_path, '^src1/', '') end inside from files")
def relative_path(spark, d):
    f = fixtures.files(spark, d)
    return f.select("id", F.when(F.col("rel_path").startswith("src1/"), paths.relative(F.col("rel_path"), F.lit("src1"))).alias("inside"))


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when microsecond(ts) % 1000000 = 0 then '' else '.' || rtrim(strftime(ts, '%f'), '0') end || '+00:00' printed, ts as parsed, epoch_us(ts) // 1000000 - 5400 * (event_id % 3) as shifted from events""")
def rfc3339_times(spark, d):
    """Moments printed and read back, and read with other offsets."""
    e = spark.read.parquet(f"{d}/events.parquet")
    text = times.print_time(F.col("ts").cast("timestamp"))
    offsets = F.array(*map(F.lit, ["Z", "+01:30", "+03:00"]))
    moved = F.concat(F.expr("substring(printed, 1, length(printed) - 6)"), F.get(offsets, (F.col("event_id") % 3).cast("int")))
    return e.select("event_id", "ts", text.alias("printed")).select("event_id", "printed", times.parse_time(F.col("printed")).cast("timestamp_ntz").alias("parsed"), F.unix_timestamp(times.parse_time(moved)).alias("shifted"))


@query("select event_id, case when event_id % 4 = 0 or event_id % 100 >= 90 then '?' when s < 60 then s || ' seconds' when s < 3600 then (s // 60) || 'min' || lpad(cast(s % 60 as varchar), 2, '0') || 's' else (s // 3600) || 'h' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || 'min' || lpad(cast(s % 60 as varchar), 2, '0') || 's' end eta from (select event_id, cast(floor((90 - event_id % 100) * (event_id % 977 + 1) * 1.0::double / greatest(case when event_id % 4 = 0 then 0 else event_id % 100 end, 1)) as bigint) s from events)")
def time_left(spark, d):
    """What a progress line says is left; a question mark where nothing is known."""
    e, k = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    return e.select("event_id", units.format_eta(F.when(k % 4 == 0, 0).otherwise(k % 100), F.lit(90), (k % 977 + 1).cast("double")).alias("eta"))
