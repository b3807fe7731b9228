"""Tables that Spark takes for smaller than they are (behind a function, an explode or a well compressed file) are not broadcast."""

import pytest

from copytrail.llm import blocks, graph, lines, simhash
from tests.llm.test_operators import docs_of, prose


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written_plans(monkeypatch):
    """The plans of all that a module writes to the shared folder."""
    def watch(*modules):
        plans = []
        for module in modules:
            def kept(frame, name, write=module.written):
                plans.append((name, plan(frame)))
                return write(frame, name)

            monkeypatch.setattr(module, "written", kept)
        return plans

    return watch


def test_keys_of_fingerprints_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "marks")
    spark.createDataFrame([(i, (i // 2 << 32 | i).to_bytes(8)) for i in range(300)], "node long, fp binary").write.parquet(path)
    paired = blocks.pair_blocks(simhash.block_keys(spark.read.parquet(path), 64, 6, 2), "node")
    assert "Broadcast" not in plan(paired)
    rows = paired.collect()
    assert "Broadcast" not in plan(paired)
    assert {r.node for r in rows} == set(range(300))
    assert all((r._part, r._lo, r._hi) == (0, 0, 0) for r in rows)


def test_rounds_of_many_links_are_not_broadcast(spark, monkeypatch, written_plans):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    plans = written_plans(graph)
    assert {r.component for r in graph.components(chain).collect()} == {0}
    monkeypatch.setattr(graph, "FEW", 39)
    few = len(plans)
    nodes = spark.range(50).withColumnRenamed("id", "node")
    joined = nodes.join(graph.components(chain), "node", "left")
    assert len(plans) > few + 1 and not any("Broadcast" in p for _, p in plans[few:])
    assert "Broadcast" not in plan(joined)
    assert sorted((r.node, r.component) for r in joined.collect()) == [(i, 0 if i < 41 else None) for i in range(50)]


def test_recurring_lines_are_not_broadcast(spark, monkeypatch, written_plans):
    notice = "Sign up for the weekly letter and never miss a story"
    copied = prose(1, 80)
    texts = [f"{prose(100 + k, 60)}\n{notice}" for k in range(24)] + [f"{copied} {prose(300 + k, 5)}\n{notice}" for k in range(6)]
    plans, links = written_plans(lines), []
    monkeypatch.setattr(lines, "components", lambda frame: links.append(plan(frame)) or graph.components(frame))
    kept = {r.doc_id: r for r in lines.drop_recurring(docs_of(spark, texts)).collect()}
    assert [kept[k].text for k in range(30)] == [t.split("\n")[0] for t in texts]
    assert len(links) == 1 and "Broadcast" not in links[0]
    assert "Broadcast" not in dict(plans)["busy_lines"]
    assert "recurring" in dict(plans)


def test_members_of_near_texts_are_not_broadcast(spark, monkeypatch, written_plans):
    plans, joined = written_plans(simhash), []
    monkeypatch.setattr(simhash, "pair_blocks", lambda keyed, *a, **b: joined.append(plan(keyed)) or blocks.pair_blocks(keyed, *a, **b))
    texts = [prose(k // 2, 200) + (" again" if k % 2 else "") for k in range(30)]
    kept = simhash.keep_representatives(docs_of(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 30, 2))
    assert "Broadcast" not in dict(plans)["members"]
    assert len(joined) == 2 and not any("Broadcast" in p for p in joined)
