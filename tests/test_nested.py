import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lotwise.functions import structure
from lotwise.operators.nested import Child, shred

SPEC = [Child("organization", "organizations"), Child("role", "roles", "organization", scalars=True), Child("lot", "lots"), Child("criterion", "criteria", "lot")]

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=5), x, max_size=3), max_leaves=12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(VALUES, max_size=4) | st.dictionaries(st.text(max_size=5), VALUES, max_size=4), min_size=1, max_size=4))
def test_index_finds_all_containers(values):
    ix = structure.build([json.dumps(v, ensure_ascii=i % 2 == 0).encode() for i, v in enumerate(values)])
    assert ix.valid.all()

    def count(v):
        inner = v.values() if isinstance(v, dict) else v if isinstance(v, list) else []
        return isinstance(v, dict | list) + sum(map(count, inner))

    assert len(ix.open) == sum(map(count, values))
    tops = [i for i in range(len(ix.open)) if ix.parent[i] < 0]
    assert [int(ix.count[i]) for i in tops] == [len(v) for v in values]


def test_broken_texts_have_no_rows():
    ix = structure.build([b"", b"{", b'{"a": [}]}', b"null", b'{"a": 1} x', b'{"lots": [{"a"', b'{"a": "\\""}'])
    assert ix.valid.tolist() == [False] * 6 + [True]


def test_shred(spark):
    bodies = [
        {"dossier": {"organizations": {"id": "1", "name": "x", "roles": "buyer; appeal,buyer"}, "lots": {"LOT-1": {"id": "LOT-1", "criteria": None}, "LOT-2": {"awarding": {"criteria": [{"name": "a"}, {"name": "b"}]}}}}},
        {"procedure": {"lots": [None, {"id": "2", "criteria": json.dumps([{"name": "q"}])}]}, "organizations": [{"roles": ["buyer", "buyer"]}, {"roles": []}]},
    ]
    rows = [(i, json.dumps(b), "extra") for i, b in enumerate(bodies)] + [(8, None, "x"), (9, '{"lots": [', "x")]
    df = spark.createDataFrame(rows, "id int, body string, child string")
    got = sorted((r.id, r.child, r.parent_pos, r.pos) for r in shred(df, ["id"], "body", SPEC).collect())
    assert got == [
        (0, "criterion", 2, 1), (0, "criterion", 2, 2), (0, "lot", 0, 1), (0, "lot", 0, 2), (0, "organization", 0, 1),
        (0, "role", 1, 1), (0, "role", 1, 2), (0, "role", 1, 3),
        (1, "criterion", 2, 1), (1, "lot", 0, 2), (1, "organization", 0, 1), (1, "organization", 0, 2), (1, "role", 1, 1), (1, "role", 1, 2),
    ]
    assert shred(df.limit(0), ["id"], "body", SPEC, raw=True).count() == 0
