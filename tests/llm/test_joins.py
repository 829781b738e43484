"""Tables that grow with the input never go through the driver, however small they look."""

import pytest

from skysift.llm import links, near, secrets, simhash


@pytest.fixture
def plans(monkeypatch):
    """Plans of all tables that the modules write."""
    found = []
    for module in (simhash, links, near, secrets):
        real = module.materialize

        def note(df, name, real=real):
            found.append((name, plan_of(df)))
            return real(df, name)

        monkeypatch.setattr(module, "materialize", note)
    return found


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def copies(spark, prose):
    words = prose(300, 3).split()
    texts = [" ".join(words[:i] + [f"x{i}"] + words[i + 1 :]) for i in range(0, 300, 20)] + [prose(80, i) for i in range(10)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_variants_are_not_broadcast(spark, prose, plans):
    plans.append(("result", plan_of(simhash.classes(copies(spark, prose)))))
    assert {"variants", "links", "components"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []


def test_pairs_and_sets_are_not_broadcast(spark, prose, plans):
    docs = copies(spark, prose)
    plans.append(("result", plan_of(near.keep_one(docs))))
    assert {"shared-shingles", "easy-pairs", "near-pairs", "first-links", "rooted"} <= {name for name, _ in plans}
    allowed = {"shingles"}  # meets hashes of texts only, eight bytes in files as in memory
    assert [name for name, plan in plans if "Broadcast" in plan and name not in allowed] == []
    ledger = secrets.new_ledger(spark)
    secrets.scan_unseen(secrets.as_versions(docs), ledger)
    assert "Broadcast" not in plan_of(secrets.redact(docs, ledger))
