"""Content keys, stored records, dependency graphs and verified files."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import lookup, scratch
from .checks import InvalidInput, assert_empty, assert_unique, require
from .dag import closure, settle


def canonical_json(value: object, *, ascii_only: bool = False) -> str:
    """JSON with sorted keys and no spaces; identities escape what is not ASCII, stored records keep it."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)


def config_identity(config: dict) -> str:
    """SHA-256 of a configuration's canonical JSON."""
    return hashlib.sha256(canonical_json(config, ascii_only=True).encode()).hexdigest()


def parse_json_object(text: str) -> dict:
    """The object that text holds; anything else is an error."""
    found = json.loads(text)
    if not isinstance(found, dict):
        raise InvalidInput("a record must be a JSON object")
    return found


#: The control characters that JSON writes with a letter, by their UTF-16 code.
JSON_SHORT = {"0022": '\\"', "005C": "\\\\", "000A": "\\n", "000D": "\\r", "0009": "\\t", "0008": "\\b", "000C": "\\f"}
ARTIFACT_KEY_VERSION = 1


def json_text(value: Column) -> Column:
    """A string as JSON writes it with escapes: what is not printable ASCII as \\uXXXX, beyond U+FFFF as two of them."""

    plain = r"[ !#-\[\]-~]"

    def written(code: Column) -> Column:
        out = F.when(code > "005C", F.concat(F.lit("\\u"), F.lower(code)))
        for char, short in JSON_SHORT.items():
            out = out.when(code == char, short)
        return out.otherwise(F.concat(F.lit("\\u"), F.lower(code)))

    def units(codes: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), (F.length(codes) / 4).cast("int") - 1), lambda i: F.substring(codes, i * 4 + 1, F.lit(4)))
        return F.array_join(F.transform(each, written), "")

    # runs of plain characters stay as they are, others are encoded once
    run = lambda p: F.when(p.rlike("^" + plain), p).otherwise(F.transform(F.array(F.hex(F.encode(p, "UTF-16BE"))), units)[0])
    escaped = F.array_join(F.transform(F.regexp_extract_all(value, F.lit(f"{plain}+|[^{plain[1:]}+"), F.lit(0)), run), "")
    return F.concat(F.lit('"'), F.when(value.rlike(f"^{plain}*\\z"), value).otherwise(escaped), F.lit('"'))


def json_value(value: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a column of this type, with sorted keys, no spaces and escapes; null is null.

    Structs, arrays, strings, whole numbers and booleans; fractions between 0.001
    and 10 million, which are written the same everywhere. Others raise an error.
    """
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(("," if k else "") + json.dumps(f.name) + ":"), json_value(value[f.name], f.dataType)) for k, f in enumerate(sorted(kind.fields, key=lambda f: f.name))]
        text = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_value(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StringType):
        text = json_text(value)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.NullType)):
        exact = (F.abs(value).between(0.001, 9999999.0)) | (value == 0)
        text = require(exact, value.cast("string"), "a fraction that JSON writes in several ways") if isinstance(kind, T.DoubleType) else value.cast("string")
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical JSON")
    return F.when(value.isNull(), "null").otherwise(text)


def canonical_key_json(df: DataFrame, columns: list[str]) -> Column:
    """Canonical JSON of an object of these columns of df, in the engine; any characters, null kept."""
    named = T.StructType([df.schema[c] for c in columns])
    return json_value(F.struct(*columns), named)


def artifact_key(domain: str) -> Column:
    """The content key of what makes an artifact, from the columns that say it.

    output_kind; inputs, an array of (artifact_kind, sha256) in their order;
    producer (implementation, version, revision); configuration_sha256; model
    (name, version, revision) and checkpoint (identifier, sha256), null where
    none was used; hardware_runtime_sha256, which is left out where null. Only
    revisions and the model's version may be null within these; a missing
    other part or a digest that is not 64 lower-case hexadecimal digits is an error.
    domain is the name under which keys are told from other digests.
    """
    missing = F.raise_error(F.lit("a part of an artifact's key is missing"))
    text, digest = json_text, lambda c: require(c.rlike(r"^[0-9a-f]{64}\z"), F.concat(F.lit('"'), c, F.lit('"')), "a digest is malformed")
    maybe = lambda c: F.coalesce(json_text(c), F.lit("null"))
    each = lambda x: F.coalesce(F.concat(F.lit('{"artifact_kind":'), text(x["artifact_kind"]), F.lit(',"sha256":'), digest(x["sha256"]), F.lit("}")), missing)
    col = F.col
    model = F.concat(F.lit('{"name":'), text(col("model.name")), F.lit(',"revision":'), maybe(col("model.revision")), F.lit(',"version":'), maybe(col("model.version")), F.lit("}"))
    checkpoint = F.concat(F.lit('{"identifier":'), text(col("checkpoint.identifier")), F.lit(',"sha256":'), digest(col("checkpoint.sha256")), F.lit("}"))
    inputs = F.transform("inputs", each)
    material = F.concat(
        F.lit('{"checkpoint":'), F.when(col("checkpoint").isNull(), "null").otherwise(checkpoint),
        F.lit(',"configuration_sha256":'), digest(col("configuration_sha256")),
        F.lit(f',"domain":{json.dumps(domain)}'),
        F.when(col("hardware_runtime_sha256").isNull(), "").otherwise(F.concat(F.lit(',"hardware_runtime_sha256":'), digest(col("hardware_runtime_sha256")))),
        F.lit(',"inputs":['), F.array_join(inputs, ","),
        F.lit('],"model":'), F.when(col("model").isNull(), "null").otherwise(model),
        F.lit(',"output_kind":'), text(col("output_kind")),
        F.lit(',"producer":{"implementation":'), text(col("producer.implementation")), F.lit(',"revision":'), maybe(col("producer.revision")), F.lit(',"version":'), text(col("producer.version")),
        F.lit(f'}},"schema_version":{ARTIFACT_KEY_VERSION}}}'),
    )
    return F.concat(F.lit(f"artifact-key:v{ARTIFACT_KEY_VERSION}:"), F.sha2(F.coalesce(material, missing), 256))  # the text is made once


def config_key(df: DataFrame, columns: list[str]) -> Column:
    """config_identity of configurations in columns of df, in the engine."""
    return F.sha2(canonical_key_json(df, columns), 256)


def native_model_ref(identity: Column) -> Column:
    """The id of a solver's own model as evidence, from the identity of its files."""
    return F.concat(F.lit("artifact:native-model:"), identity)


def derived_id(prefix: str, *parts: Column) -> Column:
    """An id of 48 hexadecimal digits from the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 48))


def model_identity(files: DataFrame) -> DataFrame:
    """model_id, identity: a hash over the model's files (position, path, sha256, byte_length) in order."""
    entry = F.to_json(F.struct("byte_length", "path", "sha256"))
    rows = files.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("position", entry.alias("e")))).alias("f"))
    return rows.select("model_id", F.sha2(F.concat(F.lit("["), F.array_join(F.transform("f", lambda x: x["e"]), ","), F.lit("]")), 256).alias("identity"))


def new_records(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """What a batch of (record_type, record_id, payload) adds to the stored records.

    Equal records change nothing; a record whose id is stored, or comes again, with another
    payload is an error, and nothing of the batch is added then.
    """
    key = ["record_type", "record_id"]
    batch = scratch(batch.select(*key, "payload").distinct(), "put-batch")
    assert_unique(batch, key, "a record comes with two payloads")
    clash = batch.join(stored.select(*key, F.col("payload").alias("held")), key).where("payload <> held")
    assert_empty(clash.select(*key), "a stored record has another payload")
    return batch.join(stored, key, "left_anti").select(*key, "payload")


def put_records(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """stored with new_records of the batch."""
    return stored.select("record_type", "record_id", "payload").unionByName(new_records(stored, batch))


def get_record(stored: DataFrame, record_type: str, record_id: str) -> DataFrame:
    return stored.where((F.col("record_type") == record_type) & (F.col("record_id") == record_id))


def duplicate_classes(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets of equal sha256 and byte_length, as classes of two or more and as members.

    Classes: class_id (the least observation_id), sha256, byte_length, n (how
    many observations). Members: observation_id, class_id. However many copies
    there are, a copy is one row.
    """
    key = ["sha256", "byte_length"]
    sizes = assets.select("observation_id", *key).distinct().groupBy(*key).agg(F.count("*").alias("n"), F.min("observation_id").alias("class_id"))
    classes = scratch(sizes.where("n > 1"), "duplicate-classes")
    members = assets.select("observation_id", *key).distinct().join(lookup(classes), key).select("observation_id", "class_id")
    return classes.select("class_id", *key, "n"), members


def with_duplicates(assets: DataFrame, stored: DataFrame | None = None, *, most: int = 10_000) -> DataFrame:
    """assets with duplicates: sorted ids of others of equal sha256 and byte_length, from what was stored before.

    Nothing is dropped. Without stored, the assets themselves are looked through.
    Every copy lists all others, which is fit for small classes only: one of
    more than most observations is an error; duplicate_classes takes any.
    """
    key = ["sha256", "byte_length"]
    pool = (assets if stored is None else stored).select("observation_id", *key)
    sizes = scratch(pool.groupBy(*key).agg(F.count_distinct("observation_id").alias("n")).where("n > 1" if stored is None else "n > 0"), "duplicate-sizes")
    assert_empty(sizes.where(F.col("n") > most), "a class of equal files is too large to be listed with each of them")
    groups = pool.join(lookup(sizes.select(*key)), key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_set("observation_id")).alias("ids"))
    joined = assets.join(lookup(scratch(groups, "duplicate-groups")), key, "left")
    none = F.expr("cast(array() as array<string>)")
    return joined.withColumn("duplicates", F.coalesce(F.array_remove("ids", F.col("observation_id")), none)).drop("ids")


def find_by_content(assets: DataFrame, sha256: str, byte_length: int) -> DataFrame:
    return assets.where((F.col("sha256") == sha256.lower()) & (F.col("byte_length") == byte_length)).select("observation_id").orderBy("observation_id")


def find_by_key(artifacts: DataFrame, keys: DataFrame) -> DataFrame:
    """The artifacts whose artifact_key is among keys, in order of project, id and kind."""
    return artifacts.join(keys.select("artifact_key").distinct(), "artifact_key", "left_semi").orderBy("project_id", "artifact_id", "kind")


def check_dag(nodes: DataFrame, edges: DataFrame) -> int:
    """Check a dependency graph (artifact depends on dependency); returns how many layers it has.

    A node has one kind, edges join declared nodes, none to itself, and there is no cycle.
    """
    assert_empty(nodes.groupBy("artifact").agg(F.count_distinct("kind").alias("kinds")).where("kinds > 1"), "a node has two kinds")
    ends = edges.select("artifact").union(edges.select("dependency")).distinct()
    assert_empty(ends.join(nodes, "artifact", "left_anti"), "an edge has an undeclared end")
    assert_empty(edges.where("artifact = dependency"), "a node depends on itself")
    found = settle(edges, "artifact", "dependency", stop_at_cycle=True)
    if found.cyclic.limit(1).count():
        raise InvalidInput("the graph has a cycle")
    return found.longest + 1


def invalidation_closure(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """artifact, depth: the roots and all that depend on them, by the shortest way."""
    assert_empty(roots.join(nodes, "artifact", "left_anti"), "a root is not declared")
    found, _ = closure(edges, "artifact", "dependency", roots.select(F.col("artifact").alias("node")))
    return found.select(F.col("node").alias("artifact"), F.col("depth").cast("int").alias("depth"))


def dependencies_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """artifact, dependencies: sorted; leaves have none, unknown artifacts have no row."""
    sets = edges.groupBy("artifact").agg(F.array_sort(F.collect_set("dependency")).alias("dependencies"))
    return nodes.select("artifact").join(sets, "artifact", "left").select("artifact", F.coalesce("dependencies", F.expr("cast(array() as array<string>)")).alias("dependencies"))


def direct_dependents(edges: DataFrame, dependency: str) -> DataFrame:
    return edges.where(F.col("dependency") == dependency).select("artifact").distinct()


def verify_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    """artifact_id, status, problems: CORRUPTED beats MISSING beats VERIFIED over the files of an artifact.

    expected has artifact_id, path, sha256, byte_length; found path, sha256,
    byte_length. An unsafe path is corrupted.
    """
    held = found.select("path", F.col("sha256").alias("s2"), F.col("byte_length").alias("n2"))
    joined = expected.join(held, "path", "left")
    severity = F.when(~safe_path(F.col("path")), 2).when(F.col("s2").isNull(), 1).when((F.col("s2") != F.lower("sha256")) | (F.col("n2") != F.col("byte_length")), 2).otherwise(0)
    grouped = joined.withColumn("v", severity).groupBy("artifact_id").agg(F.max("v").alias("v"), F.count_if(F.col("v") > 0).alias("problems"))
    return grouped.select("artifact_id", F.element_at(F.array(F.lit("VERIFIED"), F.lit("MISSING"), F.lit("CORRUPTED")), F.col("v") + 1).alias("status"), "problems")


def safe_path(path: Column) -> Column:
    """Whether a path is relative, with plain parts only."""
    return (F.length(path) > 0) & ~path.rlike(r"[\\\x00]|^/|^[A-Za-z]:|(?:^|/)\.{0,2}(?:/|$)")


def safe_path_text(path: str) -> bool:
    return bool(path) and not re.search(r"[\\\x00]|^/|^[A-Za-z]:|(?:^|/)\.{0,2}(?:/|$)", path)


def check_ancestry(result: DataFrame, inputs: DataFrame) -> None:
    """The ancestry (id, kind) of a result must be exactly that of its inputs."""
    assert_empty(result.select("id", "kind").exceptAll(inputs.select("id", "kind").distinct()), "an ancestor that no input has")
    assert_empty(inputs.select("id", "kind").distinct().exceptAll(result.select("id", "kind")), "an ancestor is missing")


def check_new_identity(result_ids: DataFrame, input_ids: DataFrame) -> None:
    """A result must not reuse an id of its inputs."""
    assert_empty(result_ids.join(input_ids, "id", "left_semi"), "a result has the id of an input")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def check_references(refs: DataFrame, *, order: tuple[str, str] = ("kind", "id")) -> None:
    """References of an owner (owner, position, kind, id) must be unique and in order."""
    assert_unique(refs, ["owner", "kind", "id"], "a reference occurs twice")
    ranked = refs.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("position", *order))).alias("r"))
    ordered = F.transform("r", lambda x: F.struct(*(x[c] for c in order)))
    assert_empty(ranked.where(ordered != F.array_sort(ordered)).select("owner"), "references are not in order")
