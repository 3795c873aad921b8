"""Markup with embedded ERB as a table of nodes, one row a node in preorder.

The parser is the one Python boundary of the engine. It never fails: an end tag without a start is
ignored, an element left open ends with its parent, paragraphs and list items close as in HTML.
"""

from __future__ import annotations

import gc
import operator
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset(("script", "style"))
CLOSES_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}

_NEXT = re.compile(r"<%|<!--|<![A-Za-z]|</?[A-Za-z]")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_PART = re.compile(
    r"""\s*(?:(?P<erb><%.*?%>)|(?P<end>/?>)|(?P<name>[^\s=>"'/<]+)(?:\s*=\s*(?P<value>"(?:<%.*?%>|[^"<]|<(?!%))*+"|'(?:<%.*?%>|[^'<]|<(?!%))*+'|(?:<%.*?%>|[^\s>"'<]|<(?!%))+))?|(?P<other>.))""",
    re.S,
)
_ERB = re.compile(r"<%.*?%>", re.S)
_NEWLINE = re.compile("\n")
_OPENS = re.compile(r"\bdo\b\s*(?:\|[^|]*\|)?\s*\Z|\A\s*(?:if|unless|case|while|until|for|begin)\b")
_CLOSES = re.compile(r"\A\s*end\b")

ATTRIBUTE = "struct<name:string,static_value:string,has_value:boolean,has_erb:boolean,line:int,column:int,val_line:int,val_column:int>"
_NODE = (
    "node_id int, parent_id int, subtree_end int, depth int, kind string, tag string, line int, column int, text string, "
    f"attrs array<{ATTRIBUTE}>, has_erb_output boolean, visible_text string, shape string, shape_size int, labelled boolean"
)
NODE = f"path string, {_NODE}"
TREE = f"path string, content string, nodes array<struct<{_NODE.replace(' int', ':int').replace(' string', ':string').replace(' boolean', ':boolean').replace('attrs array', 'attrs:array')}>>"
_ATTRIBUTE_TYPES = {"name": pa.string(), "static_value": pa.string(), "has_value": pa.bool_(), "has_erb": pa.bool_(), "line": pa.int32(), "column": pa.int32(), "val_line": pa.int32(), "val_column": pa.int32()}
_TYPES = {
    "node_id": pa.int32(), "parent_id": pa.int32(), "subtree_end": pa.int32(), "depth": pa.int32(), "kind": pa.string(), "tag": pa.string(), "line": pa.int32(), "column": pa.int32(), "text": pa.string(),
    "attrs": pa.list_(pa.struct(list(_ATTRIBUTE_TYPES.items()))), "has_erb_output": pa.bool_(), "visible_text": pa.string(), "shape": pa.string(), "shape_size": pa.int32(), "labelled": pa.bool_(),
}
_PLAIN = [f for f in _TYPES if f != "attrs"]
#: A batch ends with the file that reaches so many characters.
BATCH_CHARS = 500_000


class _Node:
    """A node in the making: the columns, and what is folded into an element until it ends."""

    __slots__ = (*_TYPES, "shapes", "size", "texts")

    def __init__(self, node_id: int, parent_id: int | None, depth: int, kind: str, tag: str | None, line: int, column: int, text: str | None, attrs: list[tuple]):
        self.node_id = self.subtree_end = node_id
        self.parent_id, self.depth, self.kind, self.tag, self.line, self.column, self.text, self.attrs = parent_id, depth, kind, tag, line, column, text, attrs
        self.has_erb_output = self.labelled = False
        self.visible_text = self.shape = self.shape_size = None
        self.shapes, self.size, self.texts = None, 0, None


class _Tree:
    """Nodes as they come; what ancestors need of their descendants is folded upwards when an element ends."""

    def __init__(self, source: str):
        self.source = source
        self.starts = [0, *(m.end() for m in _NEWLINE.finditer(source))]
        self.nodes: list[_Node] = []
        self.open: list[_Node] = []  # elements and ERB blocks

    def place(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1] + 1

    def add(self, kind: str, offset: int, tag: str | None = None, text: str | None = None, attrs: list[tuple] | None = None) -> _Node:
        line = bisect_right(self.starts, offset)
        parent = self.open[-1] if self.open else None
        node = _Node(len(self.nodes), parent.node_id if parent else None, len(self.open), kind, tag, line, offset - self.starts[line - 1] + 1, text, attrs or [])
        self.nodes.append(node)
        if kind == "void":
            node.shape, node.shape_size, node.visible_text = tag, 1, ""
            if parent is not None:
                self._child(parent, tag, 1)
        return node

    def _child(self, parent: _Node, shape: str, size: int) -> None:
        if parent.kind == "element":  # what lies in an ERB block is no direct child
            if parent.shapes is None:
                parent.shapes = [shape]
            else:
                parent.shapes.append(shape)
            parent.size += size

    def text(self, offset: int, text: str) -> None:
        if text:
            self.add("text", offset, text=text)
            if self.open:
                own = self.open[-1]
                if own.texts is None:
                    own.texts = [text]
                else:
                    own.texts.append(text)

    def erb(self, start: int, end: int) -> None:
        source = self.source[start:end]
        body = source[2:-2].rstrip("-") if source.endswith("%>") else source[2:]
        if body.startswith("#"):
            self.add("erb_comment", start, text=source)
            return
        output = source.startswith("<%=") and not source.startswith("<%==")
        code = body.lstrip("=-")
        if _CLOSES.match(code):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].kind in ("erb_code", "erb_output"):
                    self.close(i)
                    break
            return
        node = self.add("erb_output" if output else "erb_code", start, text=source)
        if output and self.open:
            self.open[-1].has_erb_output = True
        if _OPENS.search(code):
            self.open.append(node)

    def close(self, index: int) -> None:
        """End the open node at this place of the stack and those within it."""
        last = len(self.nodes) - 1
        while len(self.open) > index:
            node = self.open.pop()
            node.subtree_end = last
            element = node.kind == "element"
            if element:
                node.visible_text = "".join(node.texts).strip() if node.texts else ""
                node.shape = f"{node.tag}({','.join(node.shapes)})" if node.shapes else node.tag
                node.shape_size = node.size + 1
            if self.open:
                parent = self.open[-1]
                if node.has_erb_output:
                    parent.has_erb_output = True
                if node.texts:
                    if parent.texts is None:
                        parent.texts = node.texts
                    else:
                        parent.texts += node.texts
                if element:
                    self._child(parent, node.shape, node.shape_size)
            node.texts = node.shapes = None

    def close_tag(self, tag: str, within: tuple[str, ...] = (), inline_only: bool = False) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            own = self.open[i]
            if own.kind != "element":
                if within or inline_only:
                    return
                continue
            if own.tag == tag:
                self.close(i)
                return
            if own.tag in within or inline_only and own.tag in CLOSES_PARAGRAPH:
                return

    def label(self) -> None:
        """Mark the elements whose id a label of the file is for."""
        wanted = {_first(n.attrs, "for") for n in self.nodes if n.tag == "label"} - {None}
        for node in self.nodes if wanted else ():
            node.labelled = bool(node.attrs) and _first(node.attrs, "id") in wanted


def _first(attrs: list[tuple], name: str) -> str | None:
    return next((a[1] for a in attrs if a[0] == name), None)


def _attribute(tree: _Tree, match: re.Match) -> tuple:
    """The fields of ATTRIBUTE in order."""
    line, column = tree.place(match.start("name"))
    name, value = match["name"].lower(), match["value"]
    if value is None:
        return name, None, False, False, line, column, line, column
    quoted = value[:1] in "\"'"
    inner = value[1:-1] if quoted else value
    val_line, val_column = tree.place(match.start("value") + quoted)
    erb = "<%" in inner
    return name, _ERB.sub("", inner) if erb else inner, True, erb, line, column, val_line, val_column


def _walk(source: str) -> list[_Node]:
    tree, at, size = _Tree(source), 0, len(source)
    while at < size:
        found = _NEXT.search(source, at)
        if not found:
            tree.text(at, source[at:])
            break
        start, lead = found.start(), found[0]
        if start > at:
            tree.text(at, source[at:start])
        at = start
        if lead == "<%":
            end = source.find("%>", at)
            end = size if end < 0 else end + 2
            tree.erb(at, end)
            at = end
        elif lead == "<!--":
            end = source.find("-->", at)
            end = size if end < 0 else end + 3
            tree.add("comment", at, text=source[at:end])
            at = end
        elif lead.startswith("<!"):
            end = source.find(">", at)
            end = size if end < 0 else end + 1
            tree.add("comment", at, text=source[at:end])
            at = end
        elif lead.startswith("</"):
            tag = _NAME.match(source, at + 2)[0].lower()
            end = source.find(">", at)
            if tag not in VOID:
                tree.close_tag(tag)
            at = size if end < 0 else end + 1
        else:
            name = _NAME.match(source, at + 1)
            tag, at, attrs, ended = name[0].lower(), name.end(), [], False
            if source.startswith(">", at):
                at, ended = at + 1, True
            while at < size and not ended:
                part = _PART.match(source, at)
                if not part:
                    at = size
                    break
                at = part.end()
                if part.lastgroup == "end":
                    ended = True
                elif part["name"]:
                    attrs.append(_attribute(tree, part))
            if tag in CLOSES_PARAGRAPH:
                tree.close_tag("p", inline_only=True)
            elif tag in SIBLINGS:
                tree.close_tag(tag, within=SIBLINGS[tag])
            if tag in VOID:
                tree.add("void", start, tag, attrs=attrs)
                continue
            tree.open.append(tree.add("element", start, tag, attrs=attrs))
            if tag in RAW_TEXT and ended:
                end = re.compile(rf"</{tag}\b", re.I).search(source, at)
                stop = end.start() if end else size
                if stop > at:
                    tree.add("text", at, text=source[at:stop])
                at = stop
    tree.close(0)
    tree.label()
    return tree.nodes


def parse(source: str | None) -> list[dict]:
    """The nodes of a source in preorder."""
    return [{f: getattr(n, f) for f in _PLAIN} | {"attrs": [dict(zip(_ATTRIBUTE_TYPES, a)) for a in n.attrs]} for n in _walk(source or "")]


_ROW = operator.attrgetter(*_PLAIN)


def _columns(found: list[_Node]) -> list[pa.Array]:
    """The columns of nodes, in the order of _TYPES."""
    columns = dict(zip(_PLAIN, zip(*map(_ROW, found)) if found else [()] * len(_PLAIN)))
    attrs = [a for n in found for a in n.attrs]
    fields = zip(*attrs) if attrs else [()] * len(_ATTRIBUTE_TYPES)
    struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(fields, _ATTRIBUTE_TYPES.values())], fields=[pa.field(f, t) for f, t in _ATTRIBUTE_TYPES.items()])
    ends = pa.array(accumulate((len(n.attrs) for n in found), initial=0), pa.int32())
    return [pa.ListArray.from_arrays(ends, struct) if f == "attrs" else pa.array(columns[f], t) for f, t in _TYPES.items()]


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without garbage collection: nodes are many, make no cycles, and each collection would visit them all again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _parsed(batches: Iterator[pa.RecordBatch], build: Callable[[list[str | None], list[str | None], list[list[_Node]]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `build` makes of the paths, contents and nodes of some files at a time."""

    def built(own: list[tuple[str | None, str | None]]) -> pa.RecordBatch:
        with _uncollected():
            return build([p for p, _ in own], [c for _, c in own], [_walk(c or "") for _, c in own])

    own, chars = [], 0
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            own.append((path.as_py(), content.as_py()))
            chars += len(own[-1][1] or "")
            if chars >= BATCH_CHARS:
                yield built(own)
                own, chars = [], 0
    if own:
        yield built(own)


def nodes(files: DataFrame) -> DataFrame:
    """The nodes of files(path, content); null content gives no rows. Cache it: all detectors read it."""

    def build(paths, contents, trees):
        each = pa.array([path for path, tree in zip(paths, trees) for _ in tree], pa.string())
        return pa.RecordBatch.from_arrays([each, *_columns([n for tree in trees for n in tree])], names=["path", *_TYPES])

    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(lambda batches: _parsed(batches, build), NODE)


def trees(files: DataFrame) -> DataFrame:
    """(path, content, nodes) of files(path, content): all nodes of a file in its row, so that what needs the source needs no join."""

    def build(paths, contents, trees):
        struct = pa.StructArray.from_arrays(_columns([n for tree in trees for n in tree]), fields=[pa.field(f, t) for f, t in _TYPES.items()])
        ends = pa.array(accumulate(map(len, trees), initial=0), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.string()), pa.ListArray.from_arrays(ends, struct)], names=["path", "content", "nodes"])

    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(lambda batches: _parsed(batches, build), TREE)


def elements(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("kind").isin("element", "void"))


def tag_tokens(tree: DataFrame) -> DataFrame:
    """(path, tokens): for each file the opening tag, what is inside, and the closing tag; void elements once."""
    event = lambda at, close, deep: F.struct(at.alias("at"), F.lit(close).alias("close"), deep.alias("deep"), "tag")
    opened, closed = event(F.col("node_id"), 0, F.lit(0)), event(F.col("subtree_end"), 1, -F.col("depth"))
    each = elements(tree).select("path", F.explode(F.when(F.col("kind") == "element", F.array(opened, closed)).otherwise(F.array(opened))).alias("e"))
    return each.groupBy("path").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["tag"]).alias("tokens"))
