"""Reading HTML: the one Python stage of the engine.

`page_nodes` turns each page into arrays of elements and texts. Everything after it (selection,
fallbacks, coercion) is column expressions over those arrays. The stage needs no shuffle and its
batches are bounded by bytes on the way in and on the way out.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pagemill.schemas import ELEMENTS, LD, TEXTS

# Elements that never have content, and elements whose text is not page text.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
HIDDEN = frozenset("script style template rt rp".split())
LD_TYPE = "application/ld+json"

#: A page's elements take some thirty times its bytes while they are Python objects.
OUT_CHARS = 256 << 10


def page_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the HTML column by `els`, `texts` and `ld`; a page that cannot be read gets nulls."""
    kept = [field for field in pages.schema.fields if field.name != html]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
        + [f"els {ELEMENTS}", f"texts {TEXTS}", f"ld {LD}"]
    )
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _PageReader()
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index(html)).cast(pa.binary())
            for start, stop in _byte_slices(raw):
                part = batch.slice(start, stop - start)
                columns = [part.column(part.schema.get_field_index(n)) for n in names]
                # Crawled bytes need not be sound UTF-8.
                trees = [
                    reader.read(None if body is None else str(body, "utf-8", "replace"))
                    for body in raw.slice(start, stop - start).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    columns + _to_arrow(trees), names=[*names, "els", "texts", "ld"]
                )

    return pages.select(*names, html).mapInArrow(run, schema)


def _byte_slices(bodies: pa.BinaryArray) -> Iterator[tuple[int, int]]:
    """Runs of pages that are decoded, read and sent on together; only one is held at a time."""
    start = size = 0
    for stop, length in enumerate(pc.binary_length(bodies).to_pylist(), 1):
        size += length or 0
        if size >= OUT_CHARS or stop == len(bodies):
            yield start, stop
            start, size = stop, 0


class _PageReader(HTMLParser):
    """Collects one page's elements, texts and structured-data scripts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)

    def read(self, html: str | None) -> tuple[list, list, list] | None:
        if html is None:
            return None
        self.reset()
        self.els, self.texts, self.ld = [], [], []
        self.number = 0
        self.pending: list[str] = []
        self.path: list[list] = [[-1, 0, -1, 0, "", "", {}, 0]]
        self.names: Counter[str] = Counter()
        self.hidden = 0
        try:
            self.feed(html)
            self.close()
        except Exception:
            # Whatever a page does to the tokenizer, it costs that page's record and no more.
            return None
        self._end_text()
        while len(self.path) > 1:
            self._leave()
        return self.els, self.texts, self.ld

    def updatepos(self, i: int, j: int) -> int:
        """No line numbers are kept; counting them costs time on every tag."""
        return j

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._end_text()
        values = {name: value or "" for name, value in attrs}
        classes = values.get("class", "").split()
        parent = self.path[-1]
        parent[7] += 1
        cls = f" {' '.join(classes)} " if classes else ""
        element = [self.number, self.number + 1, parent[0], parent[7], tag, cls, values, 0]
        self.number += 1
        self.els.append(element)
        if tag not in VOID:
            self.path.append(element)
            self.names[tag] += 1
            self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave()

    def handle_endtag(self, tag: str) -> None:
        self._end_text()
        if self.names[tag]:
            while self._leave() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_entityref(self, name: str) -> None:
        self.pending.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name: str) -> None:
        digits = name[1:] if name[0] in "xX" else name
        self.pending.append(_character(int(digits, 16 if name[0] in "xX" else 10)))

    def handle_comment(self, data: str) -> None:
        self._end_text()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data: str) -> None:
        self._end_text()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[6:])
            self._end_text()

    def _leave(self) -> str:
        element = self.path.pop()
        element[1] = self.number
        self.names[element[4]] -= 1
        self.hidden -= element[4] in HIDDEN
        return element[4]

    def _end_text(self) -> None:
        if not self.pending:
            return
        raw = "".join(self.pending)
        self.pending.clear()
        if self.hidden:
            holder = self.path[-1]
            if holder[4] == "script" and holder[6].get("type") == LD_TYPE:
                self.ld.append(raw)
            return
        text = raw.strip()
        if text:
            self.texts.append((self.number, text))
            self.number += 1


def _character(code: int) -> str:
    if 128 <= code < 160:
        return bytes([code]).decode("windows-1252", "replace")
    if code == 0 or code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return "\N{REPLACEMENT CHARACTER}"
    return chr(code)


def _plain_json(text: str) -> str | None:
    """The block with repeated keys resolved to the last one, as a JSON reader does.

    Numbers that are none, or too large for one, stay as text.
    """
    try:
        return json.dumps(json.loads(text, parse_constant=str, parse_float=_finite))
    except (ValueError, RecursionError):
        return None


def _finite(text: str) -> float | str:
    number = float(text)
    return number if math.isfinite(number) else text


def _to_arrow(trees: list[tuple[list, list, list] | None]) -> list[pa.Array]:
    def offsets(which: int) -> pa.Array:
        bounds, total = [], 0
        for tree in trees:
            bounds.append(None if tree is None else total)
            total += 0 if tree is None else len(tree[which])
        return pa.array([*bounds, total], pa.int32())

    read = [tree for tree in trees if tree is not None]
    els = [element for tree in read for element in tree[0]]
    texts = [text for tree in read for text in tree[1]]
    ld = [_plain_json(block) for tree in read for block in tree[2]]

    attr_bounds = [0]
    for element in els:
        attr_bounds.append(attr_bounds[-1] + len(element[6]))
    attrs = pa.MapArray.from_arrays(
        pa.array(attr_bounds, pa.int32()),
        pa.array([name for element in els for name in element[6]], pa.string()),
        pa.array([value for element in els for value in element[6].values()], pa.string()),
    )
    ints = [pa.array([element[at] for element in els], pa.int32()) for at in range(4)]
    strings = [pa.array([element[at] for element in els], pa.string()) for at in (4, 5)]
    elements = pa.StructArray.from_arrays(
        [*ints, *strings, attrs], names=["i", "e", "p", "k", "tag", "cls", "attrs"]
    )
    words = pa.StructArray.from_arrays(
        [
            pa.array([text[0] for text in texts], pa.int32()),
            pa.array([text[1] for text in texts], pa.string()),
        ],
        names=["i", "s"],
    )
    return [
        pa.ListArray.from_arrays(offsets(0), elements),
        pa.ListArray.from_arrays(offsets(1), words),
        pa.ListArray.from_arrays(offsets(2), pa.array(ld, pa.string())),
    ]
