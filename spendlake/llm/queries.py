"""The queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, filter_audit, language_id, license_scan, line_dedup, merkle, mix_sources, near_dedup, \
    permute, shards, substring_dedup, top_k, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run
    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """The text of a public vocabulary file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@query("op1_line_dedup", r"""
WITH doc AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
win AS (
  SELECT doc_id, text, i AS pos, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS w
  FROM (SELECT *, unnest(range(len(lines) - 2)) AS i FROM doc WHERE len(lines) > 2)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth FROM win),
gone AS (
  SELECT doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) AS gone FROM ranked WHERE nth > 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string([lines[i + 1] FOR i IN range(len(lines)) IF NOT list_contains(gone, i)], chr(10)) END AS text
FROM doc d LEFT JOIN gone g ON d.doc_id = g.doc_id""")
def op1(spark, folder):
    return line_dedup.remove_repeats(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "text")


# The given tables hold no dated list, so the query makes one from them: every third page puts
# its host, the domain above it or its address on a list, every fifth takes it off, on a day
# that follows from the page's number. A page is fetched on a day that follows from it too.
DAYS = 365


def url_list(pages: DataFrame) -> DataFrame:
    host = url_filter.host_of(F.col("url"))
    kind = F.when(F.col("page_id") % 7 == 0, "url").otherwise("domain")
    above = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(host)
    return pages.where("page_id % 3 = 0").select(
        F.when(F.col("page_id") % 4 == 0, "allow").otherwise("block").alias("list"), kind.alias("kind"),
        F.when(kind == "url", url_filter.address_of(F.col("url"), host)).otherwise(above).alias("key"),
        (F.col("page_id") * 37 % DAYS).alias("day"), (F.col("page_id") % 5 != 0).alias("active"))


_HOST = r"""nullif(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(url,
    '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\.+$', ''), '')"""


@query("op2_url_filter", rf"""
WITH page AS (SELECT page_id, url, page_id * 53 % {DAYS} AS d, {_HOST} AS host FROM pages),
addressed AS (SELECT *, host || regexp_extract(url, '^[^:]*://[^/?#]*([^#]*)', 1) AS address FROM page),
entry AS (
  SELECT CASE WHEN page_id % 4 = 0 THEN 'allow' ELSE 'block' END AS list,
    CASE WHEN page_id % 7 = 0 THEN 'url' ELSE 'domain' END AS kind,
    CASE WHEN page_id % 7 = 0 THEN address WHEN page_id % 2 = 0 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END AS key,
    page_id * 37 % {DAYS} AS day, page_id % 5 <> 0 AS active
  FROM addressed WHERE page_id % 3 = 0),
daily AS (
  SELECT list, kind, key, day, bool_and(active) AS active FROM entry
  WHERE key IS NOT NULL AND day IS NOT NULL GROUP BY ALL),
valid AS (
  SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, kind, key ORDER BY day) AS until FROM daily) WHERE active),
asked AS (
  SELECT page_id, d, 'url' AS kind, address AS key, 1048576 AS depth FROM addressed WHERE host IS NOT NULL
  UNION ALL
  SELECT page_id, d, 'domain', array_to_string(parts[i:], '.'), len(parts) - i + 1
  FROM (SELECT page_id, d, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT page_id, d, string_split(host, '.') AS parts FROM addressed WHERE host IS NOT NULL))),
met AS (
  SELECT a.page_id, v.list, v.key, v.day, row_number() OVER (
    PARTITION BY a.page_id ORDER BY a.depth DESC, v.list DESC, v.key DESC, v.day DESC) AS nth
  FROM asked a JOIN valid v ON a.kind = v.kind AND a.key = v.key AND v.day <= a.d AND (v.until IS NULL OR a.d < v.until))
SELECT p.page_id, p.url, d AS fetched, host,
  CASE WHEN host IS NULL OR d IS NULL THEN 'unknown' ELSE coalesce(m.list, 'pass') END AS verdict,
  m.key AS rule, m.day AS rule_since
FROM page p LEFT JOIN met m ON p.page_id = m.page_id AND m.nth = 1""")
def op2(spark, folder):
    pages = table(spark, folder, "pages")
    captures = pages.select("page_id", "url", (F.col("page_id") * 53 % DAYS).alias("fetched"))
    return url_filter.judge(captures, url_list(pages))


@query("op3_minhash_dedup")
def op3(spark, folder):
    return near_dedup.mark(table(spark, folder, "documents"))


@query("op4_bpe")
def op4(spark, folder):
    return bpe.encode_texts(table(spark, folder, "documents"), vocabulary_file()).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op5_exact_dedup", r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)""")
def op5(spark, folder):
    return exact_dedup.mark_copies(table(spark, folder, "documents"))


@query("op6_top_k", r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM scored)
WHERE nth <= 5""")
def op6(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return top_k.top_k(vectors, vectors.where("vec_id % 50 = 0"))


# The checksum runs over bytes with a table of 256 values; the walk repeats the network.
_CRC = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t)"""


def crc_sql(text: str) -> str:
    """The unsigned checksum of a text, beside the table ``crc``."""
    return f"""xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex({text}), '..'),
      lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295))"""


_SHARDS = f"""
WITH RECURSIVE {_CRC},
doc AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {crc_sql("coalesce(text, '')")} AS text_crc32
  FROM documents, crc),
n AS (SELECT count(*) AS n, CAST(floor(sqrt(greatest(count(*) - 1, 0))) AS BIGINT) + 1 AS a FROM documents),
s AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM n),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x FROM doc),
walk AS (
  SELECT x, {permute.network_sql('x', 'a', 'b', shards.SEED)} AS p FROM numbered, s
  UNION ALL
  SELECT x, {permute.network_sql('p', 'a', 'b', shards.SEED)} FROM walk, s WHERE p >= n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {shards.SHARDS} AS INTEGER) AS shard,
  p // {shards.SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walk USING (x), s WHERE p < n"""


@query("op7_sharding", _SHARDS)
def op7(spark, folder):
    return shards.assign(table(spark, folder, "documents"))


_P = permute.P


def _turns() -> str:
    return " ".join(f"WHEN {t} THEN {permute.mixed_sql('block::BIGINT', permute.keys(mix_sources.SEED + 1 + t, 1)[0])}"
                    for t in range(mix_sources.TRIES))


_MIX = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
put AS (
  SELECT *, {permute.mixed_sql(f'(((coalesce(doc_id, size) % {_P}) + {_P}) % {_P})', permute.keys(mix_sources.SEED, 1)[0])} % {mix_sources.BLOCKS} AS block
  FROM doc),
blocks AS (SELECT source, block, CAST(sum(size) AS BIGINT) AS words FROM put GROUP BY ALL),
src AS (
  SELECT source, CAST(sum(words) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nr
  FROM blocks GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][nr % 3 + 1] AS w, 2 * source_size AS cap FROM src),
total AS (SELECT sum(source_size) * 1.5::DOUBLE AS t, sum(w) AS all_w FROM weighed),
tried AS (
  SELECT weighed.*, (t - (sum(cap) OVER o - cap)) / (all_w - (sum(w) OVER o - w)) * w > cap AS capped
  FROM weighed, total WINDOW o AS (ORDER BY cap / w::DOUBLE, nr)),
rate AS (
  SELECT coalesce((any_value(t) - coalesce(sum(cap) FILTER (capped), 0))
    / nullif(any_value(all_w) - coalesce(sum(w) FILTER (capped), 0), 0), 0) AS rate FROM tried, total),
target AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE rate * w END AS target FROM tried, rate),
placed AS (
  SELECT b.*, source_size, target, floor(target / source_size) AS passes, target - floor(target / source_size) * source_size AS rest, tries.t
  FROM blocks b JOIN target t ON b.source IS NOT DISTINCT FROM t.source, (SELECT unnest(range({mix_sources.TRIES})) AS t) AS tries WHERE words > 0),
turned AS (
  SELECT *, row_number() OVER (PARTITION BY source, t ORDER BY CASE t {_turns()} END, block) AS turn FROM placed),
walk AS (
  SELECT source, t, CAST(0 AS BIGINT) AS turn, any_value(rest) AS rest, CAST(NULL AS BOOLEAN) AS taken FROM placed GROUP BY source, t
  UNION ALL
  SELECT w.source, w.t, b.turn, CASE WHEN b.words <= w.rest THEN w.rest - b.words ELSE w.rest END, b.words <= w.rest
  FROM walk w JOIN turned b ON w.source IS NOT DISTINCT FROM b.source AND w.t = b.t AND b.turn = w.turn + 1),
walked AS (
  SELECT b.source, b.t, b.block, b.words, b.turn, w.taken, min(w.rest) OVER (PARTITION BY b.source, b.t) AS rest,
    row_number() OVER (PARTITION BY b.source, b.t ORDER BY w.taken, b.words, b.turn) AS nth_left
  FROM turned b JOIN walk w ON w.source IS NOT DISTINCT FROM b.source AND w.t = b.t AND w.turn = b.turn),
chosen AS (
  SELECT *, taken OR (nth_left = 1 AND words < 2 * rest) AS drawn,
    min(CASE WHEN NOT taken AND words < 2 * rest THEN words - rest ELSE rest END) OVER (PARTITION BY source, t) AS miss FROM walked),
best AS (SELECT source, arg_min(t, (miss, t)) AS t FROM chosen GROUP BY source),
drawn AS (
  SELECT p.source, p.block, CAST(p.passes AS INTEGER) + CASE WHEN c.drawn THEN 1 ELSE 0 END AS copies
  FROM placed p JOIN best b ON p.source IS NOT DISTINCT FROM b.source AND p.t = b.t
    JOIN chosen c ON p.source IS NOT DISTINCT FROM c.source AND p.t = c.t AND p.block = c.block)
SELECT doc_id, size, source_size, target, size * coalesce(copies, 0) AS taken, coalesce(copies, 0) AS copies
FROM put p JOIN target t ON p.source IS NOT DISTINCT FROM t.source
  LEFT JOIN drawn d ON p.source IS NOT DISTINCT FROM d.source AND p.block = d.block"""


@query("op8_mix_sources", _MIX)
def op8(spark, folder):
    copies = F.size("draws")
    return mix_sources.plan(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"),
        copies.cast("int").alias("copies"))


@query("op10_language_id")
def op10(spark, folder):
    return language_id.identify(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query("op9_license_scan")
def op9(spark, folder):
    return license_scan.scan_texts(table(spark, folder, "documents")).drop("spans")


def _leaf_sql(text: str) -> str:
    fields = [f"CAST({name} AS VARCHAR)" for name in merkle.FIELDS[:-1]] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _levels_sql(first: str, name: str, levels: int) -> str:
    """Tables ``name0`` to ``name{levels}`` of a tree's nodes, and ``name_up``: what each first node passes on its way.

    ``first`` has ``tree, pos, node``. Every level keeps ``n``, its number of nodes; a tree with one node left keeps it.
    """
    out = [f"{name}0 AS (SELECT tree, pos, node, count(*) OVER (PARTITION BY tree) AS n FROM ({first}))"]
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS (
  SELECT tree, pos // {merkle.FAN} AS pos, CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE min(node) END AS node,
    (n + {merkle.FAN - 1}) // {merkle.FAN} AS n FROM {name}{k} GROUP BY tree, pos // {merkle.FAN}, n)""")
        beside = lambda rows: f"coalesce(string_agg(node, '') OVER (PARTITION BY tree, pos // {merkle.FAN} ORDER BY pos ROWS BETWEEN {rows}), '')"
        out.append(f"""{name}_by{k} AS (
  SELECT tree, pos, n, {beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l,
    {beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k})""")
    joins = " ".join(f"JOIN {name}_by{k} b{k} ON a.tree = b{k}.tree AND a.pos // {merkle.FAN ** k} = b{k}.pos" for k in range(levels))
    runs = ", ".join(f"CASE WHEN b{k}.n > 1 THEN [b{k}.l, b{k}.r] END" for k in range(levels))
    out.append(f"""{name}_up AS (
  SELECT a.tree, a.pos, t.node AS top, list_filter([{runs}], lambda x: x IS NOT NULL) AS path
  FROM {name}0 a {joins} JOIN {name}{levels} t ON a.tree = t.tree)""")
    return ",\n".join(out)


#: Levels that the SQL of op13 can say: sources of up to 16 ** 5 rows, up to 16 ** 3 sources.
_HEIGHTS = (5, 3)
_MERKLE = f"""
WITH {_CRC},
row AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS tree, {_leaf_sql('text')} AS node,
    {_leaf_sql(f"translate(text, '{merkle.UPPER}', '{merkle.UPPER.lower()}')")} AS changed,
    coalesce({crc_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0, false) AS tampered
  FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM row),
{_levels_sql('SELECT tree, pos, node FROM placed', 's', _HEIGHTS[0])},
tops AS (SELECT tree AS source, row_number() OVER (ORDER BY tree) - 1 AS pos, node FROM s{_HEIGHTS[0]}),
{_levels_sql("SELECT '' AS tree, pos, node FROM tops", 't', _HEIGHTS[1])},
whole AS (
  SELECT p.*, s.top AS subroot, t.top AS root, s.path || t.path AS path
  FROM placed p JOIN s_up s ON p.tree = s.tree AND p.pos = s.pos JOIN tops ON tops.source = p.tree JOIN t_up t ON t.pos = tops.pos)
SELECT doc_id, node AS leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[1] || x[2]), '')) AS proof_sha256,
  folded AS folded_root, folded = root AS verified
FROM (SELECT *, list_reduce(list_transform(path, lambda x: x[1] || '|' || x[2]),
    lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2)),
    CASE WHEN tampered THEN changed ELSE node END) AS folded FROM whole)"""


@query("op13_merkle_manifest", _MERKLE)
def op13(spark, folder):
    return merkle.prove(table(spark, folder, "documents"))


_AUDIT = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
label AS (
  SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
marked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(x, '[A-Z]')) > 10 * length(x) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 16 ELSE 0 END AS mask
  FROM doc LEFT JOIN label ON doc_id = id),
cell AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY ALL),
orders AS (
  SELECT '' AS o
  UNION ALL
  SELECT o || letter FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) WHERE NOT contains(o, letter)),
step AS (
  SELECT o AS filter_order, step, CAST(1 << (ascii(o[step]) - 65) AS BIGINT) AS own,
    CAST(list_sum([1 << (ascii(l) - 65) FOR l IN string_split(o[:step - 1], '') IF l <> '']) AS BIGINT) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step) WHERE length(o) = 5),
played AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | coalesce(earlier, 0)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cell, step GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM played"""


@query("op12_filter_audit", _AUDIT)
def op12(spark, folder):
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


_SUBSTRINGS = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS seq
  FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)),
later AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY seq) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM later)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM doc),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k ON d.doc_id = k.doc_id"""


@query("op11_substring_dedup", _SUBSTRINGS)
def op11(spark, folder):
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))
