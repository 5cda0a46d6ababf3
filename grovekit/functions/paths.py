"""Columns over folder paths. A path is an array of segments; its key is "/" and the segments joined by "/"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roots of a store and the deepest path by default.
DEFAULT_ROOTS = ("work", "personal", "inbox", "project", "global")
MAX_DEPTH = 5
#: Names that stand for an operation.
OPS = ("ADD", "UPDATE", "DELETE", "NOOP", "MOVE", "MKDIR")


def normalize_path(path: Column) -> Column:
    """Segments without white space, then without slashes at their ends; a null path is empty."""
    return F.transform(F.coalesce(path, F.array().cast("array<string>")), lambda s: F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), "^/+|/+$", ""))


def path_is_valid(path: Column) -> Column:
    """No segment of a normalised path is empty, "." or ".."."""
    return ~F.exists(path, lambda s: s.isNull() | s.isin("", ".", ".."))


def path_key(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(path, "/"))


def path_prefixes(path: Column) -> Column:
    """All prefixes from the root down, the path itself last."""
    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, F.lit(1), i))).otherwise(F.array().cast("array<array<string>>"))


def path_error(path: Column, roots: tuple[str, ...] = DEFAULT_ROOTS, max_depth: int = MAX_DEPTH) -> Column:
    """What is wrong with a normalised path as a folder; null if nothing."""
    return (
        F.when(~path_is_valid(path), F.lit("invalid path segment"))
        .when(F.size(path) == 0, F.lit("empty path not allowed"))
        .when(F.size(path) > max_depth, F.concat(F.lit("path depth "), F.size(path).cast("string"), F.lit(f" exceeds max_depth={max_depth}")))
        .when(~F.get(path, F.lit(0)).isin(*roots), F.concat(F.lit("path root "), F.get(path, F.lit(0)), F.lit(" not in fixed roots")))
    )


def normalize_op(op: Column) -> Column:
    """Upper case, NO_OPERATION as NOOP; null for what is no operation."""
    up = F.regexp_replace(F.upper(op), "^NO_OPERATION$", "NOOP")
    return F.when(up.isin(*OPS), up)


def parse_key(key: Column) -> Column:
    return F.filter(F.split(key, "/"), lambda s: s != "")


def path_text(path: Column) -> Column:
    """What a folder says of itself: its segments, and its leaf with dashes and underscores as spaces."""
    return F.concat(F.lit("folder: "), F.array_join(path, " / "), F.lit(" (topic: "), F.translate(F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit("")), "-_", "  "), F.lit(")"))


def lcp_len(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i)))).otherwise(0)


def is_prefix(a: Column, b: Column) -> Column:
    """Whether path a is a prefix of path b (equal paths included)."""
    return (F.size(a) <= F.size(b)) & (F.slice(b, F.lit(1), F.size(a)) == a)


def soft_relation(gold: Column, pred: Column, empty_policy: str = "knn") -> Column:
    """How a predicted path relates to the gold path.

    An empty prediction is a prefix of everything under the policy "knn", and a relation of its own under "strict".
    A null prediction is a failure: "none".
    """
    first = F.when(pred.isNull(), F.lit("none"))
    if empty_policy == "strict":
        first = first.when(F.size(pred) == 0, F.lit("empty"))
    return (
        first.when(pred == gold, F.lit("exact"))
        .when(is_prefix(gold, pred), F.lit("gold_prefix"))
        .when(is_prefix(pred, gold), F.lit("pred_prefix"))
        .when(F.get(gold, F.lit(0)) == F.get(pred, F.lit(0)), F.lit("same_root"))
        .otherwise(F.lit("diff_root"))
    )


def soft_hit(relation: Column) -> Column:
    return relation.isin("exact", "gold_prefix", "pred_prefix")


def branch_ok(gold: Column, pred: Column) -> Column:
    return F.coalesce(F.get(gold, F.lit(0)) == F.get(pred, F.lit(0)), F.lit(False))


def gold_class(path: Column) -> Column:
    return F.when(F.try_element_at(path, F.lit(-1)) == "results", F.lit("ends_results")).when(F.size(path) == 1, F.lit("depth1")).otherwise(F.lit("other"))


def bucket(n: Column) -> Column:
    """Occupancy of a folder."""
    return F.when(n <= 0, F.lit("0")).when(n <= 2, F.lit("1-2")).when(n <= 9, F.lit("3-9")).otherwise(F.lit("10+"))


def annotation_bucket(n: Column) -> Column:
    """Occupancy as the annotation sample has it: no bucket of its own for empty folders."""
    return F.when(n <= 2, F.lit("1-2")).when(n <= 9, F.lit("3-9")).otherwise(F.lit("10+"))


def path_for_file(root: Column, source: Column, parents: Column, max_depth: int = MAX_DEPTH) -> Column:
    """Folder of a file: slugs of root, source (unless equal to the root's) and parent folders; too deep a path keeps the root
    and its last segments."""
    from .text import slug

    r, s = slug(root), slug(source)
    full = F.concat(F.array(r), F.when(r == s, F.array().cast("array<string>")).otherwise(F.array(s)), F.transform(parents, slug))
    return F.when(F.size(full) <= max_depth, full).otherwise(F.concat(F.slice(full, 1, 1), F.slice(full, -(max_depth - 1), max_depth - 1)))
