import json

from lodestrata.operators import shred


def df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, history string")


def brute(texts):
    out = []

    def lists(i, s, o, path, parent):
        if isinstance(o, dict):
            for k, v in o.items():
                lists(i, s, v, [*path, k], parent)
        elif isinstance(o, str) and o.strip()[:1] in ("[", "{"):
            v = shred.decode(o)
            if isinstance(v, (dict, list)):
                lists(i, s, v, path, parent)
        elif isinstance(o, (list, tuple)):
            for j, v in enumerate(o):
                out.append((i, s, ".".join(path), parent, j))
                lists(i, s, v, path, j)

    for i, t in enumerate(texts):
        for s, step in enumerate(shred.steps_of(t)):
            lists(i, s, step, [], -1)
    return sorted(out)


CASES = [
    None, "", "  ", "null", "[]", "{}", "[null, null]", '{"a": [1, 2]}', '[null, {"a": {"b": [{"c": []}, {"c": ["x"]}, null, "t"]}}]', '[{"a": [[1, 2], [3]]}]',
    "[{'a': [True, None], 'b': {'c': ['x']}}]", json.dumps(json.dumps([{"a": [1], "issues_found": '["p", "q"]'}])), '﻿[{"a": [1]}]', '[{"a": [1, 2], "b": {"c": [', "not json", "[1, 2",
    '[{"a": []}, {"a": [{"f": ["x", "y"], "n": {"m": 1}}]}, {"a": [{}, {"f": ["z"]}]}]', '[[1, [2]], {"x": "[not a list"}]',
]


def test_list_elements_against_brute_force(spark):
    got = sorted(tuple(r) for r in shred.list_elements(df(spark, CASES), "id", "history").collect())
    assert got == brute(CASES)


def test_positions_rebuild_places():
    s = shred.Stripes(leaves=True)
    s.record(0, [None, {"a": [{"f": [1, 2]}, {}, {"f": [3]}], "k": 5}])
    s.record(3, [{"a": [{"f": []}]}])
    c = s.lists["a.f", 3]
    record, places, there = shred.positions(c.rows, c.reps, c.defs, 3)
    assert [tuple(int(p[i]) for p in places) for i in range(len(there)) if there[i]] == [(1, 0, 0), (1, 0, 1), (1, 2, 0)]
    k = s.fields["", "k", 1]
    assert (k.reps, k.defs, k.values) == ([0, 1], [0, 1], [None, 5])


def test_tables_keep_their_parents(spark):
    text = json.dumps([{"stage": "S", "round": 1, "verification": {"verdict": "REFINE", "issues_found": ["A", "B"], "validation_results": {"direct_candidate_audit": [{"quote": "q", "alias": "a", "failures": ["F"]}]}}}])
    t = shred.loop_tables(df(spark, [text, None]), "id", "history")
    assert [(r.id, r.step_pos, r.stage, r["round"]) for r in t["steps"].collect()] == [(0, 0, "S", 1)]
    assert [(r.role, r.verdict) for r in t["verifications"].collect()] == [("verification", "REFINE")]
    assert [(r.array_path, r.item_pos, r.quote) for r in t["candidates"].collect()] == [("verification.validation_results.direct_candidate_audit", 0, "q")]
    assert sorted((r.parent_pos, r.item_pos, r.code) for r in t["codes"].collect()) == [(-1, 0, "A"), (-1, 1, "B"), (0, 0, "F")]


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "pair bigint, history string, step_pos int, fields string, id string")
    assert shred.list_elements(empty, "pair", "history").columns == ["pair", "step_pos", "array_path", "parent_pos", "item_pos"]
    one = spark.createDataFrame([(7, '[{"a": [1]}]', 9, "x", "y"), (7, '[{"a": [1]}]', 9, "x", "y")], empty.schema)
    assert [tuple(r) for r in shred.list_elements(one, "pair", "history").collect()] == [(7, 0, "a", -1, 0)] * 2


def test_deep_and_long(spark):
    """Records in more levels than a parser's stack holds, in both spellings, and very long ones."""
    deep = [o * 2500 + c * 2500 for o, c in ("[]", "()")] + ['{"a":' * 1200 + "[1, 2]" + "}" * 1200, "[" + "{'a': [" * 300 + "'x', None, True" + "]}" * 300 + "]"]
    long = json.dumps([{"a": list(range(20_000))}])
    got = shred.list_elements(df(spark, [*deep, long, deep[0][:-1], deep[3][:-1]]), "id", "history").groupBy("id").count().collect()
    assert dict(map(tuple, got)) == {0: 2498, 1: 2498, 2: 2, 3: 302, 4: 20_000}


def test_texts_of_texts(spark):
    wrapped = ['[{"a": [1]}]']
    for _ in range(6):
        wrapped.append(json.dumps(wrapped[-1]))
    got = shred.list_elements(df(spark, wrapped), "id", "history").collect()
    assert sorted(tuple(r) for r in got) == [(i, 0, "a", -1, 0) for i in range(7)]


def test_deep_reader_agrees_with_both_readers():
    import ast
    import random

    rng = random.Random(4)

    def value(n):
        k = rng.randrange(8 if n else 5)
        if k < 6:
            return [None, True, 3.5, "a,b: [x]", -7, {}][k]
        return [value(n - 1) for _ in range(rng.randrange(4))] if k == 6 else {f"k{i}": value(n - 1) for i in range(rng.randrange(4))}

    for _ in range(300):
        v = value(4)
        text = json.dumps(v) if rng.random() < 0.5 else repr(v)
        assert shred.decode_deep(text) == v
        k = rng.randrange(len(text) + 1)
        broken = text[:k] + rng.choice(["", ",", "]", "}", ":", "1", "[", "'"]) + text[k + rng.randrange(2) :]
        try:
            want = json.loads(broken)
        except ValueError:
            try:
                want = ast.literal_eval(broken)
            except (ValueError, SyntaxError, TypeError):
                want = shred.BROKEN
        if want is shred.BROKEN:
            assert shred._deep(broken) is shred.BROKEN, broken


def test_lists_at_several_depths_and_names_that_clash(spark):
    texts = ['[{"p": {"q": [1, 2]}}]', '[{"p": [{"q": [3]}, {"q": [4, 5]}]}]', '[{"a.b": 1, "a": {"b": 2}}]']
    got = shred.list_elements(df(spark, texts), "id", "history").collect()
    assert sorted(tuple(r) for r in got) == brute(texts)
    rows = shred.shredded(df(spark, texts), "id", "history").where("id = 2").collect()
    assert [r.fields for r in rows] == [{"a.b": "2"}]
