"""The whole audit of a corpus, each file parsed once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.operators import references, structure, views
from weftmark.plans import findings
from weftmark.sources import corpus, markup


@dataclass(frozen=True)
class Options:
    scan_paths: tuple[str, ...] = ("app/views", "app/components")
    ignore: tuple[str, ...] = ()
    severity: str = "suggestion"
    similarity: float = 0.7
    pattern_size: int = 5
    pattern_count: int = 3
    class_size: int = 5
    class_count: int = 3


def audit(files: DataFrame, options: Options = Options(), registry: findings.Registry | None = None) -> DataFrame:
    """Findings of all detectors that the severity floor leaves, over files(path, content).

    The node table is cached and shared; detectors differ only in the paths they look at.
    """
    floor = findings.SEVERITIES.index(findings.parse_severity(options.severity))
    pages = files.where(corpus.matches(corpus.VIEWS) | corpus.covers("path", options.scan_paths))
    tree = markup.nodes(pages).cache()
    covered = corpus.covers("path", options.scan_paths, options.ignore)
    own = tree.where(covered)
    parts = [
        findings.of_views(views.with_snippets(views.view_drift(own, files), files)),
        findings.of_accessibility(views.with_snippets(views.accessibility(tree.where(corpus.matches(corpus.VIEWS))), files)),
    ]
    if floor >= 1:
        audited = references.controller_audit(files)
        parts += [findings.of_controllers(audited, references.controller_locations(files, audited)), findings.of_slots(references.orphan_slots(files))]
    if floor >= 2:
        plain = tree.where(corpus.matches(corpus.VIEWS) & ~corpus.ignored())
        tokens = markup.tag_tokens(tree.where(corpus.matches(corpus.PARTIALS)))
        parts += [
            findings.of_previews(references.missing_previews(files)),
            findings.of_similar(structure.similar_pairs(tokens, options.similarity)),
            findings.of_patterns(structure.shape_patterns(plain, options.pattern_size, options.pattern_count)),
            findings.of_clusters(structure.class_clusters(plain, options.class_size, options.class_count)),
        ]
    parts += registry.run(files, options.severity) if registry else []
    return findings.at_least(findings.union(*parts), options.severity)


def component_report(found: DataFrame, component: str) -> DataFrame:
    """The findings that touch a component's class file or template."""
    stem = f"app/components/{component}_component"
    return found.where(F.arrays_overlap(findings.files_of(), F.array(F.lit(f"{stem}.rb"), F.lit(f"{stem}.html.erb"))))
