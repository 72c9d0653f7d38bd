"""Selecting, naming and classifying documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.paths import GlobList, ancestors, base_name, extension, parent_path, stem
from docloom.functions.values import list_column
from docloom.storage import Checked, issue_rows, missing_if_empty

# Fixed value: the garbage patterns used when no source declares any.
DEFAULT_GARBAGE = ["*~"]

# Extension → MIME type of installable modules and templates.
MODULE_MIME = {
    "xqy": "application/xquery",
    "sjs": "application/javascript",
    "xml": "application/xml",
    "json": "application/json",
}


def select_paths(
    df: DataFrame,
    include=None,
    exclude=None,
    garbage=None,
    hook: Callable[[DataFrame], DataFrame] | None = None,
    path: str = "path",
) -> DataFrame:
    """Keep the documents the globs let through.

    Garbage goes first; then a path stays when included (no include globs means
    all) and not excluded. A rejected directory rejects all below it, so every
    directory above a file is tested as well. The test is one filter made of a
    few regular expressions, with no shuffle.

    `hook` replaces the include/exclude decision. It gets the candidates with
    `path, name, isdir, is_included, is_excluded` next to their own columns and
    returns those to keep, possibly with other columns changed. It is asked
    about directories too, each once; dropping one drops all below it.
    """
    include, exclude = GlobList(include), GlobList(exclude)
    garbage = GlobList(DEFAULT_GARBAGE if garbage is None else garbage)
    p = F.col(path)

    clean = df
    if garbage.has_file_globs():
        clean = clean.filter(~garbage.matches_file(p))
    if garbage.has_dir_globs():
        clean = clean.filter(~garbage.some_ancestor(p))

    if hook is not None:
        return _select_by_hook(clean, include, exclude, hook, path)

    if exclude.has_file_globs():
        clean = clean.filter(~exclude.matches_file(p))
    if exclude.has_dir_globs():
        clean = clean.filter(~exclude.some_ancestor(p))
    if include.has_file_globs():
        clean = clean.filter(include.matches_file(p))
    if include.has_dir_globs():
        clean = clean.filter(include.every_ancestor(p))
    return clean


def _select_by_hook(clean: DataFrame, include: GlobList, exclude: GlobList, hook, path: str) -> DataFrame:
    p = F.col(path)

    def described(df: DataFrame, column: Column, isdir: bool) -> DataFrame:
        inc = include.has_dir_globs() if isdir else include.has_file_globs()
        exc = exclude.has_dir_globs() if isdir else exclude.has_file_globs()
        inc_test = include.matches_dir if isdir else include.matches_file
        exc_test = exclude.matches_dir if isdir else exclude.matches_file
        return (
            df.withColumn("name", base_name(column))
            .withColumn("isdir", F.lit(isdir))
            .withColumn("is_included", inc_test(column) if inc else F.lit(True))
            .withColumn("is_excluded", exc_test(column) if exc else F.lit(False))
        )

    parents = clean.select(parent_path(p).alias("__parent")).distinct()
    above = parents.select(
        "__parent", F.explode(ancestors(F.concat("__parent", F.lit("/")))).alias("__dir")
    )
    dirs = above.select(F.col("__dir").alias(path)).distinct()
    kept = hook(described(dirs, p, True)).select(F.col(path).alias("__dir")).distinct()
    dropped = above.join(kept, "__dir", "left_anti").select("__parent").distinct()

    files = (
        clean.withColumn("__parent", parent_path(p))
        .join(dropped, "__parent", "left_anti")
        .drop("__parent")
    )
    return hook(described(files, p, False))


def derive_uri(df: DataFrame, base: str | None = None) -> Checked:
    """`uri` is the given URI, or else the path; `full` is the given one, or else base + path.

    Empty counts as missing. Rows left without either become issues.
    """

    def given(name: str) -> Column:
        return missing_if_empty(name) if name in df.columns else F.lit(None).cast("string")

    full = F.coalesce(given("full"), F.concat(F.lit(base or ""), given("path")))
    named = df.withColumns({"uri": F.coalesce(given("uri"), given("path")), "full": full})
    bad = named.filter(F.col("uri").isNull() | F.col("full").isNull())
    return Checked(
        named.filter(F.col("uri").isNotNull() & F.col("full").isNotNull()),
        issue_rows(
            bad,
            "document",
            F.coalesce("uri", "full"),
            F.when(F.col("uri").isNull(), "uri").otherwise("full"),
            "not-derivable",
            None,
        ),
    )


def classify_first(df: DataFrame, cases: list[tuple[str, Column]], default: str, to: str = "class") -> DataFrame:
    """Label each row with the first case that holds.

    The default takes what no case claims, as the last class of a dispatch list
    does whether or not its own test holds.
    """
    label = None
    for name, test in cases:
        label = F.when(test, name) if label is None else label.when(test, name)
    return df.withColumn(to, F.lit(default) if label is None else label.otherwise(default))


def index_class(df: DataFrame, to: str = "class") -> DataFrame:
    """Class of a range index: field, path, attribute (has a parent) or element."""

    def has(name: str) -> Column:
        return F.coalesce(F.col(name) != "", F.lit(False)) if name in df.columns else F.lit(False)

    return classify_first(
        df, [("field", has("field")), ("path", has("path")), ("attribute", has("parent"))], "element", to
    )


def route_by_root(df: DataFrame, allowed=("root", "services", "transforms"), path: str = "path") -> Checked:
    """Route by the first path segment; strays and plain files at those names are issues."""
    segment = F.split_part(F.col(path), F.lit("/"), F.lit(2))
    is_file = F.col(path) == F.concat(F.lit("/"), segment)
    known = segment.isin(list(allowed))
    routed = df.withColumn("route", segment)
    return Checked(
        routed.filter(known & ~is_file),
        issue_rows(
            routed.filter(~known | is_file),
            "document",
            F.col(path),
            "route",
            F.when(known, "not-a-directory").otherwise("unknown-root"),
            F.col("route"),
        ),
    )


def attach_mime(df: DataFrame, registry: DataFrame, path: str = "path") -> Checked:
    """Add `stem`, `ext` and the registry's `mime`, `format` by extension.

    Registry: `name, extensions, format`, extensions a list or delimited text.
    An extension listed twice belongs to the first name. Documents without a dot
    or with an unregistered extension are dropped and reported.
    """
    by_ext = (
        registry.select(F.explode(list_column(registry, "extensions")).alias("ext"), "name", "format")
        .groupBy("ext")
        .agg(F.min(F.struct("name", "format")).alias("r"))
        .select("ext", F.col("r.name").alias("mime"), F.col("r.format").alias("format"))
    )
    named = df.withColumns({"stem": stem(F.col(path)), "ext": extension(F.col(path))})
    typed = named.join(by_ext, "ext", "left")
    return Checked(
        typed.filter(F.col("mime").isNotNull()),
        issue_rows(
            typed.filter(F.col("mime").isNull()),
            "document",
            F.col(path),
            "ext",
            F.when(F.col("ext").isNull(), "no-extension").otherwise("unknown-extension"),
            F.col("ext"),
        ),
    )


def module_mime(path: Column) -> Column:
    """MIME type of a module or template by extension; null when it has none of the four."""
    pairs = [F.lit(x) for pair in MODULE_MIME.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def effective_collections(df: DataFrame, defaults: Column, own: str = "collections") -> DataFrame:
    """Own collections where they differ from the defaults as a bag, else the defaults.

    `is_override` tells which documents need their own metadata entry.
    """
    defaults = F.coalesce(defaults, F.array().cast("array<string>"))
    differs = F.coalesce(F.sort_array(F.col(own)) != F.sort_array(defaults), F.lit(False))
    return df.withColumns(
        {"is_override": differs, own: F.when(differs, F.col(own)).otherwise(defaults)}
    )


def with_fallback(df: DataFrame, defaults: DataFrame, on: list[str], props: list[str], builtin: dict | None = None) -> DataFrame:
    """Own value, else the default record's, else the built-in one, whole property by property.

    `defaults` holds at most one record per scope `on` (the environment, say);
    an equi-join brings it in, so any number of scopes is resolved in one pass.
    """
    renamed = defaults.select(*on, *[F.col(p).alias(f"__dflt_{p}") for p in props])
    joined = df.join(renamed, on, "left")

    def chain(p: str) -> Column:
        options = [F.col(p), F.col(f"__dflt_{p}")]
        if builtin and p in builtin:
            v = builtin[p]
            options.append(F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v))
        return F.coalesce(*options)

    return joined.withColumns({p: chain(p) for p in props}).drop(*[f"__dflt_{p}" for p in props])
