"""Deeply nested records as flat tables (problem 3): columnar shredding with repetition and definition levels.

A text column holds one nested record a row: a list of objects ("steps"), a lone object, the same written as a Python
literal, or any of these spelled again as a JSON string. ``Stripes`` turns a batch of records into one column per path;
each entry has a repetition level (0: a new record, k: the k-th repeated ancestor goes on) and a definition level (how
many of the repeated ancestors exist at this entry; one more if the leaf is there). ``positions`` rebuilds the places of
an entry in each of its repeated ancestors from the level sequences alone, so every flat table is read off its columns.
Optional objects between two repeated ancestors share the definition step of the nearer one, as tables need no more.
Entries for absent ancestors are written only when something follows them, as trailing gaps carry no rows.

Defined results: a null, empty, unreadable or broken-off text has no steps, so no rows; records may be nested in any
number of levels, and texts spelled as texts any number of times; a null step keeps its place and has no fields; of two
fields with one dotted name the last counts; a path that has lists at several depths has a column for each; a lone object is step 0; an empty list has no elements; text that spells an object or a list counts as
it; a list directly inside a list has the outer list's path and the outer place as parent; repeated rows come out as
often as they come in; columns besides the two named are ignored, so their names cannot clash.

Scale: one narrow pass without a shuffle, a batch at a time; a table reads only the columns of its own paths.
"""

from __future__ import annotations

import ast
import json
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROKEN = object()
_TOKEN = re.compile(r"""\s*(?:([\[\](){},:])|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s\[\](){},:"']+))""", re.S)
_CLOSES = {"]": "[", "}": "{", ")": "("}


def _scalar(token: str) -> object:
    try:
        return json.loads(token)
    except ValueError:
        return ast.literal_eval(token)


def decode_deep(s: str) -> object:
    """A JSON text or Python literal of any depth, read with a stack of its own; ValueError or SyntaxError if it is none."""
    root: list = []
    stack: list[tuple[str, object, list]] = [("", root, [])]  # opening mark, container, key that waits for its value
    need, at, end = True, 0, len(s.rstrip())  # need: a value must come (or, after an opening mark, the closing one)
    opened = False
    while at < end:
        m = _TOKEN.match(s, at)
        if not m:
            raise ValueError("no token")
        at = m.end()
        mark, token = m.groups()
        kind, box, key = stack[-1]
        if mark in ("[", "{", "("):
            if not need or kind == "{" and not key:
                raise ValueError("no place for a container")
            inner: list | dict = {} if mark == "{" else []
            stack.append((mark, inner, []))
            opened = True
            continue
        if mark in _CLOSES:
            if kind != _CLOSES[mark] or key or need and not opened and mark != ")" and box:
                raise ValueError("closed out of turn")
            stack.pop()
            value, need = box, False
            kind, box, key = stack[-1]
        elif mark == ",":
            if need or kind == "" or key:
                raise ValueError("comma out of turn")
            need, opened = True, False
            continue
        elif mark == ":":
            if kind != "{" or need or len(key) != 1:
                raise ValueError("colon out of turn")
            need, opened = True, False
            continue
        else:
            if not need:
                raise ValueError("two values in a row")
            value = _scalar(token)
            if kind == "{" and not key:
                key.append(value)
                need = opened = False
                continue
        if kind == "{":
            box[key.pop()] = value
        else:
            box.append(value)
        need = opened = False
    if len(stack) > 1 or len(root) != 1:
        raise ValueError("broken off")
    return root[0]


def decode(text: str | None) -> object:
    """The value that a text spells, texts that spell texts included; BROKEN if it spells none."""
    value: object = text
    while isinstance(value, str):
        s = value.strip().lstrip("\ufeff").strip()
        if not s:
            return BROKEN
        try:
            value = json.loads(s)
        except RecursionError:
            value = _deep(s)
        except ValueError:
            if s[0] not in "[{('\"":
                return BROKEN
            try:
                value = ast.literal_eval(s)
            except (RecursionError, MemoryError):
                value = _deep(s)
            except (ValueError, SyntaxError, TypeError):
                value = _deep(s) if s.count("[") + s.count("{") + s.count("(") > 90 else BROKEN  # literals end at 200 levels
    return value


def _deep(s: str) -> object:
    try:
        return decode_deep(s)
    except (ValueError, SyntaxError, TypeError, MemoryError):
        return BROKEN


def steps_of(text: str | None) -> list:
    """The record's list of steps."""
    if text is None:
        return []
    value = decode(text)
    if isinstance(value, (list, tuple)):
        return list(value)
    return [value] if isinstance(value, dict) else []


def _make_room(text: str | None) -> None:
    """Let the walk go as deep as a text may be nested; it is Python's own, so no other stack grows."""
    marks = text.count("[") + text.count("{") + text.count("(") if text else 0
    if marks > 150 and sys.getrecursionlimit() < 4 * marks + 1000:
        sys.setrecursionlimit(4 * marks + 1000)


def _nested(value: object) -> object:
    """A text that spells an object or a list counts as that."""
    if isinstance(value, str) and value[:1] in "[{ \n" and value.strip()[:1] in ("[", "{"):
        inner = decode(value)
        if isinstance(inner, (dict, list, tuple)):
            return inner
    return value


class Column:
    """Levels and values of one path; rows holds the record of each entry with repetition level 0."""

    __slots__ = ("rows", "reps", "defs", "values", "row", "last")

    def __init__(self) -> None:
        self.rows: list[int] = []
        self.reps: list[int] = []
        self.defs: list[int] = []
        self.values: list = []
        self.row, self.last = -1, ()

    def add(self, row: int, pos: tuple[int, ...], value: object) -> None:
        """An entry at the places pos of its repeated ancestors; skipped places get entries of a lower definition."""
        reps, defs, values = self.reps, self.defs, self.values
        depth = len(pos)
        if row != self.row:
            self.row, rep, at, start = row, 0, 0, 0
            self.rows.append(row)
        else:
            last, at = self.last, 0
            if last == pos:  # the same dotted name again
                values[-1] = value
                return
            while last[at] == pos[at]:
                at += 1
            start, rep = last[at] + 1, at + 1
        self.last = pos
        for k in range(at, depth):
            for _ in range(start, pos[k]):
                reps.append(rep)
                defs.append(k)
                values.append(None)
                rep = k + 1
            start = 0
        reps.append(rep)
        defs.append(depth)
        values.append(value)


class Stripes:
    """The columns of a batch. leaves: keep scalar fields too, else only the elements of lists."""

    def __init__(self, leaves: bool) -> None:
        self.leaves = leaves
        self.lists: dict[tuple[str, int], Column] = {}
        self.fields: dict[tuple[str, str, int], Column] = {}

    def record(self, row: int, steps: list) -> None:
        for k, step in enumerate(steps):
            step = _nested(step)
            if self.leaves:
                self._list("", 1).add(row, (k,), None)
            if isinstance(step, dict):
                self._object(row, "", "", step, (k,))
            elif isinstance(step, (list, tuple)):
                self._elements(row, "", step, (k,))

    def _list(self, path: str, depth: int) -> Column:
        column = self.lists.get((path, depth))
        if column is None:
            column = self.lists[path, depth] = Column()
        return column

    def _object(self, row: int, base: str, path: str, value: dict, pos: tuple[int, ...]) -> None:
        for key, item in value.items():
            here = f"{path}.{key}" if path else str(key)
            if isinstance(item, str):
                item = _nested(item)
            if isinstance(item, dict):
                self._object(row, base, here, item, pos)
            elif isinstance(item, (list, tuple)):
                self._elements(row, here, item, pos)
            elif self.leaves:
                column = self.fields.get((base, here, len(pos)))
                if column is None:
                    column = self.fields[base, here, len(pos)] = Column()
                column.add(row, pos, item)

    def _elements(self, row: int, path: str, items: list | tuple, pos: tuple[int, ...]) -> None:
        if not items:
            return
        column = self._list(path, len(pos) + 1)
        for j, item in enumerate(items):
            here = (*pos, j)
            if isinstance(item, str):
                item = _nested(item)
            if isinstance(item, dict):
                column.add(row, here, None)
                self._object(row, path, path, item, here)
            elif isinstance(item, (list, tuple)):
                column.add(row, here, None)
                self._elements(row, path + "\0", item, here)  # a column of its own: one repeated ancestor more
            else:
                column.add(row, here, item)


def positions(rows: list[int], reps: list[int], defs: list[int], depth: int, levels: list[int] | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Record, place in each of the depth repeated ancestors (outermost first, or those of some levels) and mask of the
    entries that exist."""
    rep, dfn = np.asarray(reps, np.int64), np.asarray(defs, np.int64)
    n = np.arange(len(rep))
    record = np.asarray(rows, np.int64)[np.cumsum(rep == 0) - 1] if len(rep) else np.zeros(0, np.int64)
    places = []
    for level in levels or range(1, depth + 1):
        on = np.cumsum(rep == level)
        begins = np.maximum.accumulate(np.where(rep < level, n, 0))  # the last entry that opens this ancestor anew
        places.append(on - on[begins])
    return record, places, dfn == depth


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


ELEMENTS = pa.schema([("step_pos", pa.int32()), ("array_path", pa.string()), ("parent_pos", pa.int32()), ("item_pos", pa.int32())])


def _elements_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stripes = Stripes(leaves=False)
        for row, text in enumerate(batch.column(1).to_pylist()):
            _make_room(text)
            stripes.record(row, steps_of(text))
        out: list[list] = [[], [], [], [], []]
        for (path, depth), column in stripes.lists.items():
            record, places, there = positions(column.rows, column.reps, column.defs, depth, [1, depth - 1, depth] if depth > 2 else [1, depth])
            out[0].append(record[there])
            out[1].append(places[0][there])
            out[2].append(np.full(int(there.sum()), path.rstrip("\0"), object))
            out[3].append(places[-2][there] if len(places) > 2 else np.full(int(there.sum()), -1))
            out[4].append(places[-1][there])
        if out[0]:
            ids = batch.column(0).take(pa.array(np.concatenate(out[0])))
            paths = pa.array(np.concatenate(out[2]), pa.string())
            numbers = [pa.array(np.concatenate(x), pa.int32()) for x in (out[1], out[3], out[4])]
            yield pa.RecordBatch.from_arrays([ids, numbers[0], paths, numbers[1], numbers[2]], names=["id", "step_pos", "array_path", "parent_pos", "item_pos"])


def list_elements(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each element of each list inside a step: (id_col, step_pos, array_path, parent_pos, item_pos)."""
    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    out = narrow.mapInArrow(_elements_batches, f"id {kind}, step_pos int, array_path string, parent_pos int, item_pos int")
    return out.withColumnRenamed("id", id_col)


def _keyed(record: np.ndarray, places: list[np.ndarray], there: np.ndarray, radix: list[int]) -> np.ndarray:
    """Record and places as one number, in order."""
    key = record[there]
    for p, r in zip(places, radix):
        key = key * r + p[there]
    return key


def _row_batches(kept: Callable[[str], bool]):
    """The rows of the lists whose path is kept; a field's entries are laid beside its list's by their levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stripes = Stripes(leaves=True)
            for row, text in enumerate(batch.column(1).to_pylist()):
                _make_room(text)
                stripes.record(row, steps_of(text))
            fields: dict[tuple[str, int], list] = {}
            for (base, path, depth), column in stripes.fields.items():
                if kept(base.rstrip("\0")):
                    fields.setdefault((base, depth), []).append((path[len(base) + 1 :] if base else path, column))
            for (path, depth), column in stripes.lists.items():
                if not kept(path.rstrip("\0")):
                    continue
                record, places, there = positions(column.rows, column.reps, column.defs, depth)
                n = int(there.sum())
                read = [(name, c, positions(c.rows, c.reps, c.defs, depth)) for name, c in fields.get((path, depth), [])]
                radix = [1 + max(int(p.max(initial=0)) for p in (places[k], *(r[2][1][k] for r in read))) for k in range(depth)]
                keys = _keyed(record, places, there, radix)
                at, names, values = [np.zeros(0, np.int64)], [], []
                for name, c, (rec, pl, on) in read:
                    at.append(np.searchsorted(keys, _keyed(rec, pl, on, radix)))
                    some = [_text(c.values[i]) for i in np.flatnonzero(on)]
                    values += some
                    names += [name] * len(some)
                rows = np.concatenate(at)
                order = pa.array(np.argsort(rows, kind="stable"))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
                maps = pa.MapArray.from_arrays(pa.array(offsets), pa.array(names, pa.string()).take(order), pa.array(values, pa.string()).take(order))
                minus = np.full(n, -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(record[there])), pa.array(places[0][there], pa.int32()), pa.array([path.rstrip("\0")] * n, pa.string()),
                        pa.array(places[-2][there] if depth > 2 else minus, pa.int32()), pa.array(places[-1][there] if depth > 1 else minus, pa.int32()),
                        pa.array([_text(column.values[i]) for i in np.flatnonzero(there)], pa.string()), maps,
                    ],
                    names=["id", "step_pos", "array_path", "parent_pos", "item_pos", "value", "fields"],
                )

    return run


def shredded(df: DataFrame, id_col: str, text_col: str, kept: Callable[[str], bool] = lambda path: True) -> DataFrame:
    """Every step (array_path '') and list element with its scalar fields (dotted names -> texts), of the paths kept."""
    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    out = narrow.mapInArrow(
        _row_batches(kept),
        f"id {kind}, step_pos int, array_path string, parent_pos int, item_pos int, value string, fields map<string,string>",
    )
    return out.withColumnRenamed("id", id_col)


ROLES = ("verification", "pre_refinement_verification", "post_refinement_verification")


def loop_tables(df: DataFrame, id_col: str, text_col: str) -> dict[str, DataFrame]:
    """The loop history as steps, verifications, candidates and codes, each with the keys of its parents.

    steps: (id, step_pos); verifications: (id, step_pos, role); candidates: (id, step_pos, array_path, item_pos);
    codes: (id, step_pos, array_path, parent_pos, item_pos), parent_pos the candidate's item_pos or -1.
    """
    at = lambda pattern: shredded(df, id_col, text_col, lambda path: bool(re.search(pattern, path)))
    rows = at("^$")
    key = [id_col, "step_pos"]
    get = lambda name: F.col("fields")[name]
    steps = rows.select(
        *key, get("stage").alias("stage"), get("round").try_cast("int").alias("round"), get("entering_label").alias("entering_label"),
        get("exiting_label").alias("exiting_label"), get("label_changed").alias("label_changed"), get("operational_error").alias("operational_error"),
        get("candidate_found").alias("candidate_found"), get("refinement.change_type").alias("change_type"),
        get("refinement.corrected_prediction").alias("corrected_prediction"), get("refinement.corrected_evidence").alias("corrected_evidence"),
    )
    names = ("feature", "prediction", "verdict", "grounding_scores.exact_match", "grounding_scores.normalized_match", "grounding_scores.grounding_level")
    scores = ("grounding_scores.rouge_l", "grounding_scores.bleu", "grounding_scores.bertscore", "label_probs.Yes", "label_probs.No")
    verifications = (
        rows
        .select(*key, "fields", F.explode(F.array(*map(F.lit, ROLES))).alias("role"))
        .where(F.exists(F.map_keys("fields"), lambda k: k.startswith(F.concat(F.col("role"), F.lit(".")))))
        .select(
            *key, "role",
            *(F.element_at("fields", F.concat(F.col("role"), F.lit("." + n))).alias(n.rpartition(".")[2]) for n in names),
            *(F.element_at("fields", F.concat(F.col("role"), F.lit("." + n))).try_cast("double").alias(n.replace(".", "_").lower() if "probs" in n else n.rpartition(".")[2]) for n in scores),
        )
    )
    candidates = at(r"(^|[.])(direct_)?candidate_audit$").select(
        *key, "array_path", "item_pos", get("quote").alias("quote"), get("alias").alias("alias"), get("accepted").alias("accepted")
    )
    codes = at(r"(^|[.])(issues_found|verifier_issues|failures|recovered_structural_failures)$").select(
        *key, "array_path", "parent_pos", "item_pos", F.col("value").alias("code")
    )
    return {"steps": steps, "verifications": verifications, "candidates": candidates, "codes": codes}
