import pytest

from vibralake import domain
from vibralake.functions import labels
from vibralake.plans import tables

EXPECTED = {
    "  Polia GASTA": "polia",
    "7_correia_z": "correia",
    "x_cocked_adxl_9": "cocked_rotor",
    "eixo desalinhado": "desalinhamento",
    "Teste de bancada": "normal",
    "vazio?": "outro_defeito",
    "\tBASELINE": "normal",
    "": "outro_defeito",
    None: "desconhecido",
}


def test_every_rule_and_state(spark):
    """An independent statement of the order: states whole, then the first fragment that occurs."""

    def category(label):
        if label is None:
            return domain.UNKNOWN
        clean = label.strip().lower()
        if clean in domain.OPERATIONAL_STATES:
            return domain.NORMAL
        return next((c for fragment, c in domain.CATEGORY_RULES if fragment in clean), domain.OTHER_FAULT)

    rows = spark.createDataFrame([(x,) for x in tables.RAW_LABELS], "fault string")
    for row in labels.with_category(rows).collect():
        assert row["fault_category"] == category(row["fault"]), row["fault"]




@pytest.fixture(scope="module")
def mapped(spark):
    rows = spark.createDataFrame([(k,) for k in EXPECTED], "fault string")
    return {r["fault"]: r for r in labels.with_category(rows).collect()}


@pytest.mark.parametrize("label", EXPECTED)
def test_category(mapped, label):
    assert mapped[label]["fault_category"] == EXPECTED[label]


def test_problem_flag(mapped):
    assert mapped[""]["is_problem"] is True
    assert mapped[None]["is_problem"] is False
    assert mapped["Teste de bancada"]["is_problem"] is False
    assert mapped["x_cocked_adxl_9"]["is_problem"] is True


def test_label_counts(spark):
    rows = spark.createDataFrame([("polia",), ("polia",), ("normal",)], "fault string")
    found = {(r["fault"], r["fault_category"]): r["n"] for r in labels.label_counts(rows).collect()}
    assert found == {("polia", "polia"): 2, ("normal", "normal"): 1}


def test_category_is_not_repeated_in_a_filter(spark):
    rows = spark.createDataFrame([("polia",)], "fault string")
    plan = labels.with_category(rows).filter("is_problem")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("cocked_adxl") <= 2
