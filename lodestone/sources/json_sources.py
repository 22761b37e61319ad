"""JSON sources: record arrays, vendor envelopes, the enrichment cache, translation chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "id string, source_url string, title_primary string, title_ko string, artist_primary string, artist_ko string, artist_aliases array<string>, "
    "karaoke_numbers struct<tj: string, ky: string, joysound: string>, categories array<string>, crawled_at string, media_context_ko string, "
    "title_ko_source string, title_ko_confidence string"
)
#: The fields of a vendor's item, and what they are called here.
ITEM = {"pro": "pro", "indexTitle": "title", "indexSong": "artist", "subTitle": "sub_title", "sortTitleKo": "sort_title_ko", "sortSongKo": "sort_song_ko", "nationalcode": "nationalcode", "publishdate": "publishdate"}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array, with seq in the array's order and the vendors' numbers as columns. A document is
    read by one task, so a large corpus comes as several of them; each is an array, they follow in the files' order."""
    each = spark.read.schema(RECORD).json(path, multiLine=True, mode="FAILFAST").withColumn("seq", F.monotonically_increasing_id())
    return each.select("seq", *[c for c in each.columns if c not in ("seq", "karaoke_numbers")], "karaoke_numbers.tj", "karaoke_numbers.ky", "karaoke_numbers.joysound")


def catalog_items(raw: DataFrame, col: str) -> DataFrame:
    """(pos, item) of resultData.items; a document without that array is an error."""
    items = F.try_variant_get(F.try_parse_json(col), "$.resultData.items", "array<variant>")
    return raw.select(F.posexplode(F.coalesce(items, F.raise_error(F.lit("resultData.items is not an array")).cast("array<variant>"))).alias("pos", "item"))


def envelope_items(raw: DataFrame, col: str, tolerate: bool) -> DataFrame:
    """(pos, item) of a flat {items} or of buckets with items* keys; code 98 is empty, any but 99 an error.
    An unknown shape gives nothing if tolerated, else it is an error."""
    v = F.try_parse_json(col)
    data = F.try_variant_get(v, "$.resultData", "variant")
    code = F.try_variant_get(v, "$.resultCode", "string")
    flat = F.try_variant_get(data, "$.items", "array<variant>")
    buckets = F.try_variant_get(data, "$", "array<map<string, variant>>")
    held = F.flatten(F.transform(buckets, lambda b: F.flatten(F.transform(F.map_values(F.map_filter(b, lambda k, _: k.startswith("items") & ~k.endswith("TotalCount"))), lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))))))
    none = F.array().cast("array<variant>")
    unknown = none if tolerate else F.raise_error(F.lit("unknown shape of resultData")).cast("array<variant>")
    items = F.when(code == "98", none).when(code != "99", F.raise_error(F.concat(F.lit("result code "), code)).cast("array<variant>")).otherwise(F.coalesce(flat, held, unknown))
    return raw.select(F.posexplode(items).alias("pos", "item"))


def item_columns(item: Column, trimmed: bool = False) -> list[Column]:
    """An item's fields as text; numbers become text, empty ones null."""
    out = []
    for path, name in ITEM.items():
        v = F.try_variant_get(item, f"$.{path}", "string")
        out.append(F.nullif(F.trim(v) if trimmed else v, F.lit("")).alias(name))
    return out


def items(each: DataFrame, trimmed: bool = False) -> DataFrame:
    """Items with a number, a title and an artist."""
    return each.select("pos", *item_columns(F.col("item"), trimmed)).where("pro IS NOT NULL AND title IS NOT NULL AND artist IS NOT NULL")


def cache_entries(raw: DataFrame, col: str, map_key: str) -> DataFrame:
    """(key, entry) of one map of the cache; a missing or malformed document gives nothing, as do entries that
    are no objects."""
    m = F.try_variant_get(F.try_parse_json(col), f"$.{map_key}", "map<string, variant>")
    return raw.select(F.explode(m).alias("key", "entry")).where(F.schema_of_variant("entry").startswith("OBJECT"))


def _text(entry: Column, name: str) -> Column:
    """A field that is a text; any other kind is null."""
    v = F.try_variant_get(entry, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(entry, f"$.{name}", "string"))


def number_entries(entries: DataFrame) -> DataFrame:
    """(pro, nationalcode, title and artist in Korean, sub_title, publishdate, last_seen) of the cache's entries by
    number; an entry without last_seen goes, other fields of a wrong kind are null."""
    e = F.col("entry")
    names = {"nationalcode": "nationalcode", "sortTitleKo": "sort_title_ko", "sortSongKo": "sort_song_ko", "subTitle": "sub_title", "publishdate": "publishdate", "lastSeen": "last_seen"}
    return entries.select(F.col("key").alias("pro"), *[_text(e, a).alias(b) for a, b in names.items()]).where("last_seen IS NOT NULL")


def artist_entries(entries: DataFrame) -> DataFrame:
    """(key, code, jpn, kor, eng, last_seen) of the cache's entries by artist; without last_seen or with an unknown
    code an entry goes, votes that are no numbers are 0."""
    e = F.col("entry")
    votes = [F.coalesce(F.try_variant_get(e, f"$.votes.{c}", "long"), F.lit(0).cast("long")).alias(c) for c in ("jpn", "kor", "eng")]
    return entries.select("key", _text(e, "code").alias("code"), *votes, _text(e, "lastSeen").alias("last_seen")).where("last_seen IS NOT NULL AND code IN ('JPN', 'KOR', 'ENG', 'AMBIGUOUS', 'UNKNOWN')")


#: Members of the cache that the engine owns; any other is an extra.
OWNED = ("version", "generatedAt", "bootstrappedAt", "proEnrichmentMap", "artistNationalityMap")


def cache_header(raw: DataFrame, col: str) -> DataFrame:
    """(version, generated_at, bootstrapped_at, extras): defaults for what is missing or of a wrong kind, and the
    other members as JSON texts by name. A malformed document is an empty cache."""
    v = F.coalesce(F.try_parse_json(col), F.parse_json(F.lit("{}")))
    members = F.coalesce(F.try_variant_get(v, "$", "map<string, variant>"), F.expr("cast(map() AS map<string, variant>)"))
    extras = F.transform_values(F.map_filter(members, lambda k, _: ~k.isin(*OWNED)), lambda _, x: F.to_json(x))
    number = F.when(F.schema_of_variant(F.try_variant_get(v, "$.version", "variant")) == "BIGINT", F.try_variant_get(v, "$.version", "long"))
    return raw.select(F.coalesce(number, F.lit(1).cast("long")).alias("version"), F.coalesce(_text(v, "generatedAt"), F.lit("1970-01-01T00:00:00.000Z")).alias("generated_at"), _text(v, "bootstrappedAt").alias("bootstrapped_at"), extras.alias("extras"))


#: What an entry of a chunk file must have, the values of its confidence, and the names of such files.
CHUNK_FIELDS, CONFIDENCES, CHUNK_FILES = ("id", "title_primary", "title_ko", "confidence", "reasoning"), ("high", "medium", "low"), "chunk-[0-9]+\\.json$"


def chunk_errors(entries: DataFrame, col: str = "entry") -> DataFrame:
    """(id, error) of entries (JSON texts) that lack a field, have an unknown confidence or an id that comes again."""
    v = F.try_parse_json(col)
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
    lacks = F.try_element_at(F.array_except(F.array(*[F.lit(x) for x in CHUNK_FIELDS]), F.coalesce(keys, F.array().cast("array<string>"))), F.lit(1))
    conf = F.try_variant_get(v, "$.confidence", "string")
    id_ = F.try_variant_get(v, "$.id", "string")
    one = entries.select(id_.alias("id"), F.when(lacks.isNotNull(), F.concat(F.lit("missing "), lacks)).when(~F.coalesce(conf.isin(*CONFIDENCES), F.lit(False)), F.concat(F.lit("confidence "), F.coalesce(conf, F.lit("null")))).alias("error"))
    twice = one.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("error"))
    return one.where("error IS NOT NULL").union(twice)


def read_chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, title_primary, title_ko, confidence, reasoning) of the output chunks in a folder; other files in it are
    not read, an entry that breaks the rules is an error."""
    raw = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_name").rlike(CHUNK_FILES))
    whole = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    entries = raw.select(F.explode(F.coalesce(whole, F.raise_error(F.lit("a chunk file is not a JSON array")).cast("array<variant>"))).alias("v")).select(F.to_json("v").alias("entry"))
    bad = chunk_errors(entries).orderBy("id", "error").limit(1).collect()
    if bad:
        raise ValueError(f"chunk files: id {bad[0].id!r}: {bad[0].error}")
    v = F.parse_json("entry")
    return entries.select(*[F.try_variant_get(v, f"$.{c}", "string").alias(c) for c in CHUNK_FIELDS])


def strings_of(col: Column) -> Column:
    """The texts of a JSON array; nothing for any other document."""
    each = F.try_variant_get(F.try_parse_json(col), "$", "array<variant>")
    own = F.transform(F.filter(each, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(own, F.array().cast("array<string>"))


def sidecar_keys(raw: DataFrame, col: str, member: str = "keys") -> DataFrame:
    """The distinct texts of an array in a sidecar document, as match keys; none where it is missing or malformed."""
    from lodestone.functions.text import match_key

    found = F.filter(F.coalesce(F.try_variant_get(F.try_parse_json(col), f"$.{member}", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) == "STRING")
    each = raw.select(F.explode(F.transform(found, lambda x: F.try_variant_get(x, "$", "string"))).alias("k")).where("k <> ''")
    return each.select(match_key(F.col("k")).alias("key")).distinct()


def sidecar_map(raw: DataFrame, col: str, member: str) -> DataFrame:
    """(key, value) of an object in a sidecar document that must be there: without it the job stops."""
    m = F.try_variant_get(F.try_parse_json(col), f"$.{member}", "map<string, string>")
    return raw.select(F.explode(F.coalesce(m, F.raise_error(F.lit(f"{member} is missing in the sidecar")).cast("map<string, string>"))).alias("key", "value"))


def read_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of chunk files; an id that comes twice, or a row without one, is an error."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    bad = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").limit(1).collect()
    if bad:
        raise ValueError(f"chunk files: id {bad[0].id!r} comes {bad[0].n} times")
    return rows


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header; missing cells are empty texts."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"').fillna("")
