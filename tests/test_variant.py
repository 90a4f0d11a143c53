"""JSON records of unknown shape against a plain Python reading."""

import json
import random

from vecspark.constants import TEXT_FIELDS
from vecspark.sources.variant import ingest_examples


def plain(line):
    """(texts [(pos, field, text)], reason)."""
    try:
        r = json.loads(line)
    except (TypeError, ValueError):
        return [], "not_json"
    if not isinstance(r, dict):
        return [], "not_object"
    as_text = lambda x: x if isinstance(x, str) else json.dumps(x)
    usable = lambda x: x is not None and not isinstance(x, (list, dict))
    p = r.get("passages")
    if isinstance(p, dict) and "passage_text" in p:
        field, one = "passages.passage_text", p["passage_text"]
    else:
        field = next((f for f in TEXT_FIELDS if r.get(f)), None)
        one = r.get(field) if field else None
    many = one if field == "passages.passage_text" and isinstance(one, list) else [one]
    out = [(i, field, as_text(x).strip()) for i, x in enumerate(many) if usable(x) and len(as_text(x).strip()) > 10]
    if out:
        return out, None
    if one is None or many is one:
        return [], "no_text"
    return [], "not_text" if isinstance(one, (list, dict)) else "too_short"


def test_every_shape(spark):
    rng = random.Random(2)
    words = ["a text that is long enough", "  padded   text here \n", "short", "", None, 7, 12345678901234, True, False, 0, [], {},
             ["in a list of its own"], {"an": "object, not a text"}, "exactly ten", "ten chars!", "grüße aus köln"]
    pick = lambda: rng.choice(words)
    records = []
    for i in range(600):
        r = {"id": i}
        if rng.random() < 0.6:
            r["passages"] = rng.choice([{"passage_text": pick()}, {"passage_text": [pick() for _ in range(rng.randrange(4))]}, {"x": 1}, pick()])
        for f in rng.sample(TEXT_FIELDS, rng.randrange(4)):
            r[f] = pick()
        records.append(json.dumps(r, ensure_ascii=rng.random() < 0.5))
    records += [None, "", "{", "[1, 2]", '"just a string of text"', "null", "17", '{"id": 9999', "{}", '{"passages": null, "text": "found all the same"}']
    got = ingest_examples(spark.createDataFrame([(x,) for x in records], "value string").withColumnRenamed("value", "line"), value="line")
    passages = {}
    for r in got.passages.collect():
        passages.setdefault(r["id"], []).append((r["pos"], r["field"], r["text"]))
    rejects = {r["id"]: r["reason"] for r in got.rejects.where("id is not null").collect()}
    for line in records[:600]:
        i = str(json.loads(line)["id"])
        texts, reason = plain(line)
        assert sorted(passages.get(i, [])) == texts and rejects.get(i) == reason, line
    assert {r[0] for r in got.rejects.select("reason").distinct().collect()} == {"not_json", "not_object", "no_text", "not_text", "too_short"}
    assert passages[None] == [(0, "text", "found all the same")]
    nameless = sorted((r["value"] or "", r["reason"]) for r in got.rejects.where("id is null").collect())
    assert nameless == sorted([(x or "", plain(x)[1]) for x in records[600:-1]])
    total = got.passages.select("id").distinct().count() + got.rejects.count()
    assert total == len(records)                                        # no record is lost
    assert ingest_examples(spark.createDataFrame([], "value string")).passages.count() == 0
