"""Repeated structure: class lists, subtree shapes, and similar files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.operators.graph import checkpointed, components
from weftmark.operators.views import static
from weftmark.sources import markup


def class_list(value: str | Column) -> Column:
    """Tokens split at white space, without empty ones, sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.split(value, r"\s+"), lambda c: c != "")))


def class_lists(tree: DataFrame, min_classes: int = 5) -> DataFrame:
    """(tag, classes, at) of the elements with long class lists."""
    own = markup.elements(tree).select("tag", class_list(static("class")).alias("classes"), F.struct(F.col("path").alias("file"), "line", "column").alias("at"))
    return own.where(F.size("classes") >= min_classes)


def class_lists_of_trees(nodes: str = "nodes", path: str = "path", min_classes: int = 5) -> Column:
    """array<struct<tag, classes, at>>: `class_lists` of a file's nodes."""
    own = lambda n: F.struct(n["tag"].alias("tag"), class_list(static("class", n.__getitem__)).alias("classes"), F.struct(F.col(path).alias("file"), n["line"].alias("line"), n["column"].alias("column")).alias("at"))
    return F.filter(F.transform(F.filter(nodes, lambda n: n["kind"].isin("element", "void")), own), lambda x: F.size(x["classes"]) >= min_classes)


def clusters(lists: DataFrame, min_occurrences: int = 3) -> DataFrame:
    """(tag, classes, count, occurrences) of equal class lists."""
    grouped = lists.groupBy("tag", "classes").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("at")).alias("occurrences"))
    return grouped.where(F.col("count") >= min_occurrences)


def class_clusters(tree: DataFrame, min_classes: int = 5, min_occurrences: int = 3) -> DataFrame:
    """(tag, classes, count, occurrences) of equal long class lists; lists are cut by size before they are grouped."""
    return clusters(class_lists(tree, min_classes), min_occurrences)


def fingerprint(shape: str | Column) -> Column:
    return F.substring(F.sha2(shape, 256), 1, 16)


def contains_shape(outer: Column, inner: Column) -> Column:
    """Whether inner stands in outer as a whole child: after ( or , and before ) or ,."""
    stands = [F.contains(outer, F.concat(F.lit(before), inner, F.lit(after))) for before in "(," for after in "),"]
    return stands[0] | stands[1] | stands[2] | stands[3]


def shape_patterns(tree: DataFrame, min_size: int = 5, min_occurrences: int = 3) -> DataFrame:
    """(fingerprint, shape, size, count, files, occurrences) of repeated subtree shapes, less those nested in another.

    A shape goes if a larger one of the same count holds it as a child and covers all of its files.
    """
    own = tree.where((F.col("kind") == "element") & (F.col("shape_size") >= min_size))
    at = F.struct(F.col("path").alias("file"), "line", "column", F.col("shape_size").alias("size"))
    grouped = own.groupBy(fingerprint("shape").alias("fingerprint")).agg(
        F.first("shape").alias("shape"), F.first("shape_size").alias("size"), F.count("*").alias("count"), F.array_sort(F.collect_set("path")).alias("files"), F.array_sort(F.collect_list(at)).alias("occurrences")
    )
    kept = grouped.where(F.col("count") >= min_occurrences)
    outer = kept.select(F.col("count").alias("o_count"), F.col("size").alias("o_size"), F.col("shape").alias("o_shape"), F.col("files").alias("o_files"))
    nested = (F.col("count") == F.col("o_count")) & (F.col("o_size") > F.col("size")) & contains_shape(F.col("o_shape"), F.col("shape")) & (F.size(F.array_except("files", "o_files")) == 0)
    return kept.join(outer, nested, "left_anti")


def ngrams(tokens: str | Column, n: int = 3) -> Column:
    """The set of windows of n tokens; fewer tokens make one window, none make no window."""
    size = F.size(tokens)
    windows = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(F.array_join(tokens, " "))).otherwise(F.array_distinct(windows))


#: Sets of up to so many grams meet over two rare grams, larger ones over one.
PAIRED_SIZE = 24


def _sets(tokens: DataFrame, n: int, min_tokens: int, files: Column) -> DataFrame:
    """(set, grams, size, files): the n-gram sets of files, each once, numbered, with what `files` makes of path and tag_count."""
    own = tokens.where(F.size("tokens") >= min_tokens).select("path", F.size("tokens").alias("tag_count"), F.array_sort(ngrams("tokens", n)).alias("grams"))
    grouped = own.groupBy(F.unhex(F.sha2(F.array_join("grams", "\n"), 256)).alias("digest")).agg(F.first("grams").alias("grams"), files.alias("files"))
    return checkpointed(grouped.select(F.monotonically_increasing_id().alias("set"), "grams", F.size("grams").alias("size"), "files"))


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(set_a, set_b), set_a < set_b, each once: all pairs of sets(set, grams, size) whose Jaccard may reach the threshold, and few others.

    A set's grams are ordered from rare to common. The k rarest grams that two sets over the threshold share lie among the first
    size - ceil(threshold * size) + k of each. So two of them meet sets of up to PAIRED_SIZE grams, unless one is all that they
    need share; larger sets, whose pairs of grams would be many, meet over one. What meets by the same hash of other grams is
    told apart when the pair is counted.
    """
    least = lambda size: F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int")
    each = sets.select("set", "size", F.explode("grams").alias("gram"))
    ranked = each.join(each.groupBy("gram").agg(F.count("*").alias("df")), "gram").select("set", "size", F.struct("df", F.xxhash64("gram").alias("gram")).alias("g"))
    ranked = ranked.groupBy("set", "size").agg(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["gram"]).alias("grams"))
    first = lambda k: F.slice("grams", F.lit(1), F.col("size") - least(F.col("size")) + k)
    two = F.flatten(F.transform(first(2), lambda g, i: F.transform(F.slice(first(2), i + 2, F.lit(PAIRED_SIZE)), lambda h: F.xxhash64(g, h))))
    one = (F.col("size") > PAIRED_SIZE) | (F.col("size") >= least(F.lit(PAIRED_SIZE + 1))) | (least(F.col("size")) < 2)
    none = F.array().cast("array<bigint>")
    keys = F.array(F.struct(F.lit(1).alias("k"), F.when(one, first(1)).otherwise(none).alias("keys")), F.struct(F.lit(2).alias("k"), F.when(F.col("size") <= PAIRED_SIZE, two).otherwise(none).alias("keys")))
    head = ranked.select("set", "size", F.inline(keys)).select("set", "size", "k", F.explode("keys").alias("key"))
    other = head.select(F.col("set").alias("set_b"), F.col("size").alias("size_b"), "k", "key")
    larger = F.greatest("size", "size_b")
    near = (F.col("set") < F.col("set_b")) & (F.least("size", "size_b") >= least(larger)) & (F.col("k") == F.when((larger <= PAIRED_SIZE) & (least(larger) >= 2), 2).otherwise(1))
    return head.join(other, ["k", "key"]).where(near).select(F.col("set").alias("set_a"), "set_b").distinct()


def _close(sets: DataFrame, threshold: float) -> DataFrame:
    """(set_a, set_b, shared, total) of unlike sets over the threshold, set_a < set_b."""
    left, right = sets.select(F.col("set").alias("set_a"), F.col("grams").alias("grams_a")), sets.select(F.col("set").alias("set_b"), F.col("grams").alias("grams_b"))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    scored = candidates(sets, threshold).join(left, "set_a").join(right, "set_b").select("set_a", "set_b", shared.alias("shared"), (F.size("grams_a") + F.size("grams_b") - shared).alias("total"))
    return scored.where(F.col("shared") / F.col("total") >= threshold)


def similar_pairs(tokens: DataFrame, threshold: float = 0.7, n: int = 3, min_tokens: int = 5) -> DataFrame:
    """(file_a, file_b, shared, total, score, tag_count_a, tag_count_b) of files whose n-gram sets have Jaccard >= threshold.

    Files with equal sets are one while pairs are sought. Every candidate is counted exactly.
    """
    sets = _sets(tokens, n, min_tokens, F.collect_list(F.struct("path", "tag_count")))
    files, close = sets.select("set", F.inline("files")), _close(sets, threshold)
    same = sets.select(F.col("set").alias("set_a"), F.col("set").alias("set_b"), F.col("size").alias("shared"), F.col("size").alias("total")).where("size(files) > 1")
    linked = close.unionByName(close.select(F.col("set_b").alias("set_a"), F.col("set_a").alias("set_b"), "shared", "total")).unionByName(same)
    one, two = (files.select(F.col("path").alias(f"file_{s}"), F.col("tag_count").alias(f"tag_count_{s}"), F.col("set").alias(f"set_{s}")) for s in "ab")
    pairs = linked.join(one, "set_a").join(two, "set_b").where("file_a < file_b")
    return pairs.select("file_a", "file_b", "shared", "total", (F.col("shared") / F.col("total")).alias("score"), "tag_count_a", "tag_count_b")


def similar_counts(tokens: DataFrame, threshold: float = 0.7, n: int = 3, min_tokens: int = 5) -> DataFrame:
    """(shared, total, pairs): how many of `similar_pairs` there are, counted by the files of each set and not pair by pair."""
    sets = _sets(tokens, n, min_tokens, F.count("path"))
    of = lambda s: sets.select(F.col("set").alias(f"set_{s}"), F.col("files").alias(f"files_{s}"))
    unlike = _close(sets, threshold).join(of("a"), "set_a").join(of("b"), "set_b").select("shared", "total", (F.col("files_a") * F.col("files_b")).alias("pairs"))
    same = sets.select(F.col("size").alias("shared"), F.col("size").alias("total"), F.expr("files * (files - 1) div 2").alias("pairs"))
    return unlike.unionByName(same).where("pairs > 0").groupBy("shared", "total").agg(F.sum("pairs").alias("pairs"))


def similarity_groups(pairs: DataFrame) -> DataFrame:
    """(files, score_min, score_max, pair_count, sample_pair) of the groups that pairs join; the sample is the best pair."""
    of = components(pairs, "file_a", "file_b")
    sizes = of.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("files"))
    best = F.struct(F.col("score"), F.struct("file_a", "file_b").alias("pair"))
    scores = pairs.join(of, F.col("file_a") == F.col("node")).groupBy("component").agg(F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.count("*").alias("pair_count"), F.max(best).alias("best"))
    return sizes.join(scores, "component").select("files", "score_min", "score_max", "pair_count", F.col("best.pair").alias("sample_pair"))
