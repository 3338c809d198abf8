"""Known inputs with known ratios.

Fixed values: the records, the ratios and the scores of this file must be as they are for right results.
"""

import copy
import json

import pytest

from paperloom.operators import evaluate as E

TRUTH = {
    "key1": "value1", "key2": {
        "key1": "value2", "key2": {"key1": "value3"}, "key3": ["value4", "value5"],
        "key4": {"key1": [{"key1": "value6", "key2": "value7"}]}, "key5": "value8"},
    "key3": "value9", "key4": "value10",
}


def found(second, third, fifth, sixth):
    return {
        "key1": "wrong_value", "key2": {
            "key1": second, "key2": {"key1": third}, "key3": ["value4", fifth], "key4": {"key1": [{"key1": sixth, "key2": "value7"}]}},
        "key4": "value10",
    }


PLAIN = found("value2", "value,3", "value5", "value6")
PUNCTUATED = found("value.2", "$value3", "value,5", "value,6")
EXACT = "CustomStringEvaluator"
OPTIONS = {"key2": {
    "key1": {EXACT: {"IGNORE_DOTS": "True"}}, "key2": {"key1": {EXACT: {"IGNORE_DOLLAR_SIGN": "True"}}},
    "key4": {"key1": [{"key1": {EXACT: {"IGNORE_COMMAS": "True"}}}]}}}
DEFAULT = {"IGNORE_DOLLAR_SIGN": True, "IGNORE_DASHES": True, "IGNORE_DOTS": True}

INVOICE = {
    "Customer Name": "Happiest Valley Farms", "Invoice Number": "1234", "Date": "November 30, 2022",
    "Billing info": {"Customer": "Henry Ross", "Customer ID": "8675309", "Address": "123 Avenue A, Metropolis", "Phone": "(123) 456-7890"},
    "Payment Due": "December 30, 2022", "Salesperson": "Luca Richter", "Payment Terms": "Cash or check",
    "Shipping info": {"Recipient": "Henry Ross", "Address": "123 Avenue A, Metropolis", "Phone": "(123) 456-7890"},
    "Delivery Date": "December 7, 2022", "Shipping Method": "Ground", "Shipping Terms": "Returns not accepted",
    "Table": {
        "Items": [
            {"Qty": 10, "Item#": 123, "Description": "Baby chicks", "Unit price": 5.0, "Discount": "10%", "Line total": 45.0},
            {"Qty": 2, "Item#": 444, "Description": "Heat lamps", "Unit price": 24.0, "Discount": "", "Line total": 48.0},
            {"Qty": 6, "Item#": 120, "Description": "Chicken roosts", "Unit price": 30.0, "Discount": "", "Line total": 180.0}],
        "Total Discount": 5.0, "Subtotal": 278.0, "Sales Tax": 13.9, "Total": 286.9},
    "Footer": {
        "Customer Name": "Happiest Valley Farms", "Address": "456 Anyroad, Anywhere", "Website": "interstingsite.com",
        "Phone number": "(123)987-6543", "Fax number": "(123)987-6542", "Email": "happiest@example.com"},
}


def read_invoice():
    """The invoice as it was read: numbers as texts with two decimals, another customer, and a few other spellings."""
    actual = copy.deepcopy(INVOICE)
    actual["Customer Name"] = "Henry Ross"
    for item in actual["Table"]["Items"]:
        item |= {k: str(item[k]) for k in ("Qty", "Item#")} | {k: f"{item[k]:.2f}" for k in ("Unit price", "Line total")}
    actual["Table"] |= {"Total Discount": "5.00", "Subtotal": "278,00", "Sales Tax": "13.90", "Total": "286.90"}
    actual["Footer"] |= {"Website": "interestingsite.com", "Phone number": "(123) 987-6543", "Fax number": "(123) 987-6542"}
    return actual


def ratios(spark, truth, actual, schema=None, chosen=E.DEFAULT_EVALUATORS):
    rows = [(1, json.dumps(truth), json.dumps(actual), None if schema is None else json.dumps(schema))]
    items = spark.createDataFrame(rows, "item long, ground_truth string, actual string, eval_schema string")
    scores = E.evaluate_json(items, ["item"], chosen).cache()
    found = {r["evaluator"]: r["ratio"] for r in E.evaluator_ratio(scores, ["item"]).collect()}
    return found, {(r["evaluator"], r["path"]): r["score"] for r in scores.collect()}


@pytest.mark.parametrize("actual, schema, chosen, exact, fuzzy", [
    (PLAIN, None, E.DEFAULT_EVALUATORS, 0.6, 0.782),
    (PUNCTUATED, OPTIONS, E.DEFAULT_EVALUATORS, 0.6, 0.764),
    (PUNCTUATED, None, (E.Evaluator(EXACT, E.EXACT.score, DEFAULT), E.FUZZY), 0.5, 0.764),
])
def test_ratios_of_ten_values(spark, actual, schema, chosen, exact, fuzzy):
    got, _ = ratios(spark, TRUTH, actual, schema, chosen)
    assert got[EXACT] == pytest.approx(exact, abs=1e-12) and got["FuzzStringEvaluator"] == pytest.approx(fuzzy, abs=1e-12)


def test_short_lists_score_what_is_there(spark):
    got, scores = ratios(spark, {"key1": "value1", "key2": ["test1", "test2", "test3"]}, {"key1": "value1", "key2": ["test1"]})
    assert got[EXACT] == 0.5
    assert [scores[EXACT, f"key2[{i}]"] for i in range(3)] == [1, 0, 0]


def test_the_sample_invoice(spark):
    """44 fields; exact ratio 0.6818181818, fuzzy ratio 0.9393181818."""
    got, scores = ratios(spark, INVOICE, read_invoice())
    assert len(scores) == 88
    assert round(got[EXACT], 10) == 0.6818181818 and round(got["FuzzStringEvaluator"], 10) == 0.9393181818
    assert scores["FuzzStringEvaluator", "Customer Name"] == 0.33 and scores[EXACT, "Table.Items[0].Unit price"] == 0
    assert scores["FuzzStringEvaluator", "Table.Items[1].Discount"] == 0 and scores["FuzzStringEvaluator", "Footer.Website"] == 1
