import pytest
from pyspark.sql import functions as F

from spanloom import api
from spanloom.functions import facts
from spanloom.operators import cascade, identity, premises, rules
from spanloom.operators.assess import grounds, quantities
from spanloom.operators.publish import grounding_errors

ANSWER = "case_id string, atom_id string, support_ids array<string>, refute_ids array<string>, context_ids array<string>, sufficiency string, missing string, reason string, title string"
SPAN = "case_id string, atom_id string, span_id string, span_ord int, document_id string, text string, context string, title string"


def run(spark, claim, texts, support=(), refute=(), context=(), sufficiency="SUFFICIENT", missing=None, reason="Said so. More.", scopes=None, upto=len(cascade.STEPS), documents=None):
    answers = spark.createDataFrame([("c", "a", list(support), list(refute), list(context), sufficiency, missing, reason, "x")], ANSWER)
    atoms = spark.createDataFrame([("c", "a", claim)], "case_id string, atom_id string, text string")
    spans = spark.createDataFrame([("c", "a", f"s{i}", i, f"d{i}", t, None, "x") for i, t in enumerate(texts)], SPAN)
    if scopes is not None:
        scopes = spark.createDataFrame([("c", "a", f"s{i}", *x) for i, x in enumerate(scopes)], "case_id string, atom_id string, span_id string, claim_scope array<string>, evidence_scope array<string>, status string")
    return cascade.assess(answers, atoms, spans, scopes, documents, upto).first()


def sides(r):
    return r["support_ids"], r["refute_ids"], r["context_ids"], r["sufficiency"]


def test_both_sides_by_span_and_by_text(spark):
    r = run(spark, "Rain fell there.", ["same", " Same ", "other", "last"], ["s0", "s2", "s2"], ["s1", "s3"], [], upto=1)
    assert sides(r) == (["s2"], ["s3"], ["s0", "s1"], "SUFFICIENT")
    assert run(spark, "Rain fell.", ["a", "b"], ["s0"], ["s0"], ["s1"], upto=1)["context_ids"] == ["s1", "s0"]


def test_jurisdictions_compared_must_be_covered(spark):
    scopes = [(["SE", "FI"], ["SE"], "MATCH"), (["SE", "FI"], ["FI"], "MATCH")]
    claim = "Sweden voted before Finland."
    assert sides(run(spark, claim, ["Sweden voted.", "Finland voted."], ["s0"], scopes=scopes, upto=2)) == ([], [], ["s0"], "SUFFICIENT")
    assert sides(run(spark, claim, ["Sweden voted.", "Finland voted."], ["s0", "s1"], scopes=scopes, upto=2))[0] == ["s0", "s1"]
    mismatch = [(["SE"], ["NO"], "MISMATCH"), (["SE"], ["SE"], "MATCH")]  # not offered at all
    assert run(spark, claim, ["Norway voted.", "Sweden voted."], ["s1"], scopes=mismatch)["n_spans"] == 1


def test_numbers_ground_relations(spark):
    claim = "The fleet has 12 boats."
    assert sides(run(spark, claim, ["The fleet has 12 boats now."], ["s0"], upto=3)) == (["s0"], [], [], "SUFFICIENT")
    r = run(spark, claim, ["The fleet has 40 boats."], ["s0"], upto=3)
    assert sides(r) == ([], [], ["s0"], "PARTIAL") and "numeric assertion" in r["reason"] and r["missing"].startswith("Evidence stating")
    assert sides(run(spark, claim, ["The fleet has 40 boats."], [], ["s0"], upto=3))[1] == ["s0"]
    r = run(spark, claim, ["The fleet is old.", "The fleet has twelve boats."], ["s0", "s1"], upto=3)  # one alone grounds it
    assert sides(r)[0] == ["s1"] and r["reason"].startswith("The retained evidence directly supports")
    assert run(spark, "Exports reached 102 million tonnes.", ["Exports reached 100 million tonnes."], ["s0"], upto=3)["reason"].startswith("The selected evidence reports a compatible rounded")


def test_counterexample_measures_conflict(spark):
    r = run(spark, "The net was developed exclusively for civilian use.", ["Fine words.", "It was developed for military needs."], ["s0", "s1"], sufficiency="PARTIAL", upto=4)
    assert sides(r) == (["s0"], ["s1"], [], "SUFFICIENT")
    r = run(spark, "Alpha is the tallest peak.", ["Alpha rises 9 km above sea level.", "Beta rises 10 km from its base."], ["s0"], ["s1"], upto=5)
    assert sides(r) == ([], [], ["s0", "s1"], "PARTIAL")
    assert sides(run(spark, "Rain fell.", ["yes", "no"], ["s0"], ["s1"], sufficiency="PARTIAL", upto=6))[3] == "SUFFICIENT"


def test_names_per_side(spark):
    claim = "Ann Lee won the race."
    r = run(spark, claim, ["Bob Ray won the race."], ["s0"])
    assert sides(r) == ([], [], ["s0"], "INSUFFICIENT") and r["demoted_ids"] == ["s0"]
    assert sides(run(spark, claim, ["Bob Ray won the race."], [], ["s0"]))[1] == ["s0"]  # a refutation may name another
    assert sides(run(spark, claim, ["Ann Lee won."], ["s0"]))[0] == ["s0"]
    assert sides(run(spark, claim, ["The race was won."], ["s0"]))[0] == ["s0"]  # nobody competes
    documents = spark.createDataFrame([("c", "d0", "Ann Lee, also known as Bob Ray, ran.")], "case_id string, document_id string, text string")
    assert sides(run(spark, claim, ["Bob Ray won the race."], ["s0"], documents=documents))[0] == ["s0"]


def test_explanations_are_cleaned(spark):
    r = run(spark, "Rain fell.", ["a"], sufficiency="PARTIAL", missing="  A date \n is needed. And more", reason="false")
    assert (r["missing"], r["reason"]) == ("A date is needed.", cascade.NO_REASON)
    assert run(spark, "Rain fell.", ["a"], ["s0"], missing="Something.")["missing"] == ""
    assert run(spark, "Rain fell.", ["a"], reason="x" * 301)["reason"] == cascade.NO_REASON
    assert run(spark, "Rain fell.", ["a"], reason="no end here")["reason"] == "no end here."


def test_rejects(spark):
    rows = [("c", "a", ["s0"], None, None, "SUFFICIENT"), ("c", "b", ["zz"], [], [], "PARTIAL"), ("c", "d", [], [], [], "MAYBE"), ("c", "e", [], [], [], "PARTIAL"), ("c", "e", [], [], [], "PARTIAL"), ("c", "x", [], [], [], "PARTIAL")]
    answers = spark.createDataFrame([(*r, None, None, "t") for r in rows], ANSWER)
    atoms = spark.createDataFrame([("c", a, "Rain fell.") for a in "abdeg"], "case_id string, atom_id string, text string")
    spans = spark.createDataFrame([("c", a, "s0", 0, "d", "t", None, "x") for a in "abde"], SPAN)
    assert {r["atom_id"]: r["reason"] for r in cascade.rejects(answers, atoms, spans).collect()} == {"b": "UNAVAILABLE_EVIDENCE", "d": "UNKNOWN_SUFFICIENCY", "e": "REPEATED_ANSWER", "x": "UNKNOWN_ATOM", "g": "MISSING_ANSWER"}
    assert [r["atom_id"] for r in cascade.assess(answers, atoms, spans).collect()] == ["a"]
    assert cascade.assess(answers.limit(0), atoms, spans).count() == 0


def test_omissions(spark):
    assessed = spark.createDataFrame([("c", "a", ["s0"], "SUFFICIENT", ["s9"]), ("k", "a", ["s0"], "PARTIAL", [])], "case_id string, atom_id string, support_ids array<string>, sufficiency string, demoted_ids array<string>")
    rows = [("c", True, ["s0"], ["s1"]), ("k", True, ["s0"], ["s1"])]
    make = lambda r: spark.createDataFrame(r, "case_id string, detected boolean, support_ids array<string>, context_ids array<string>")
    assert {r["case_id"]: (r["detected"], r["rejected"]) for r in cascade.omissions(make(rows), assessed).collect()} == {"c": (True, None), "k": (True, "UNSUPPORTED_CERTIFICATE")}
    r = cascade.omissions(make([("c", True, ["s9"], ["s1"])]), assessed).first()
    assert (r["detected"], r["support_ids"], r["rejected"]) == (False, [], None)  # what names demoted is withdrawn
    assert cascade.omissions(make([("c", True, ["s0"], [])]), assessed).first()["rejected"] == "INCOMPLETE_CERTIFICATE"
    assert cascade.omissions(make([("c", False, ["s0"], ["s1"])]), assessed).first()["support_ids"] == []


def test_quantities():
    assert quantities("5 percent of 3 million in 2019 and twenty") == [(0.05, 0.01), (3e6, 1e6), (20.0, 1.0)]
    assert grounds("It has 5 masts.", "It has five masts.", True) and not grounds("It has 5 masts.", "There were five dogs.", True) and grounds("It has 5 masts.", "That masts claim is false.", False)


@pytest.mark.parametrize(("claim", "evidence", "want"), [
    (rules.numeric_compare, ("At least 120000 people came to Bay.", ["Bay saw 130000 people."]), ("PROVED", None)),
    (rules.numeric_compare, ("The wall is more than 5 ft high.", ["The wall is 6 ft high."]), ("UNRESOLVED", "UNSUPPORTED_NUMERIC_UNIT")),
    (rules.set_membership, ("The board has included Alpha in its register.", ["The full list: \n- Alpha\n- Beta"]), ("PROVED", None)),
    (rules.set_membership, ("Gamma isn't on the list.", ["The full list: \n- Alpha\n- Beta"]), ("PROVED", None)),
    (rules.set_membership, ("Gamma is on the list.", ["The full list:\n- Alpha\n", "All items of the index:\n- Beta"]), ("UNRESOLVED", "CONFLICTING_COMPLETE_LISTS")),
    (rules.extremum, ("Alpha is the tallest peak.", ["Alpha rises 9000 above sea level.", "Beta rises 9900 from its base."]), ("UNRESOLVED", "INCOMPATIBLE_MEASURES")),
    (rules.extremum, ("Alpha is the tallest peak.", ["Beta rises 9900."]), ("UNRESOLVED", "MISSING_SUBJECT_VALUE")),
    (rules.attribute, ("The old mill has wheels.", ["Rain fell on Monday."]), ("UNRESOLVED", "MISSING_ENTITY_ALIGNMENT")),
    (rules.attribute, ("The old mill has wheels.", ["The mill never had wheels."]), ("DISPROVED", None)),
    (rules.attribute, ("The mill is located in Sweden.", ["The mill stands in Finland."]), ("DISPROVED", None)),
    (rules.temporal_compare, ("The tower opened before the bridge.", ["The tower opened in 1990."]), ("UNRESOLVED", "AMBIGUOUS_TEMPORAL_MAPPING")),
    (rules.temporal_compare, ("Alpha opened before Beta.", ["Alpha opened in 1990.", "Beta opened in 1995."]), ("PROVED", None)),
    (rules.temporal_compare, ("Alpha opened after Beta.", ["Alpha opened in 1990.", "Beta opened in 1995."]), ("DISPROVED", None)),
    (rules.temporal_compare, ("The bridge opened on May 3, 1990.", ["The bridge opened on May 3, 1990.", "Rain fell on May 4, 1990."]), ("PROVED", None)),
    (rules.temporal_compare, ("The bridge opened last May before 1990.", ["The bridge opened in 1980."]), ("UNRESOLVED", "RELATIVE_TIME")),
])
def test_rules_as_surveyed(spark, claim, evidence, want):
    atoms = spark.createDataFrame([("c", "a", evidence[0])], "case_id string, atom_id string, text string")
    rows = spark.createDataFrame([("c", "a", f"p{i}", e) for i, e in enumerate(evidence[1])], "case_id string, atom_id string, premise_id string, text string")
    r = claim(atoms, rows).first()
    assert (r["status"], r["warning"]) == want


def test_facts():
    assert facts.years("120000 and 2001") == [2001] and [u for _, u, _ in facts.numbers("5 ft, 3 lbs, 7 percent, $2 and 9")] == ["unsupported:ft", "unsupported:lbs", "percent", "currency:$", "count"]
    assert [r for *_, r in facts.intervals("June 28, 2007 and June 29; 30 February")] == ["June 28, 2007", "June 29"]
    assert [x["kind"] for x in facts.complete_lists("Two items: a and b\nThe full list:\n- x\n- y")] == ["counted", "exhaustive"]
    assert facts.complete_lists("All TARGETS (2): Alpha; Beta")[0]["items"] == ["alpha", "beta"] and facts.complete_lists("Three items: a, b") == []


def test_premises_stand_where_they_say(spark):
    text = "🚨 Opening\nThe complete list of towns:\n- Añil Bay\n- Cove\n\n  Cove | 12 boats \nno digits\n" + "x" * 501 + " 7"
    documents = spark.createDataFrame([("c", "d", text, "y"), ("c", "d", text, "y"), ("c", "e", None, "y"), ("c", "f", "", "y")], "case_id string, document_id string, text string, kind string")
    rows = premises.list_premises(documents).unionByName(premises.line_operands(documents))
    got = {r["premise_id"]: r["text"] for r in rows.collect()}
    assert got["list:d:1:item:1"] == "Añil Bay" and got["operand:d:line:5"] == "Cove | 12 boats" and len(got) == 4
    assert grounding_errors(rows, documents.where("text <> ''").distinct()).count() == 0
    assert premises.list_premises(documents.limit(0)).count() == 0


def test_candidates_have_their_premises(spark):
    atoms = spark.createDataFrame([("c", "a", "Cove is listed on the register."), ("c", "b", "Cove has the most boats."), ("c", "k", "Cove won three cups.")], "case_id string, atom_id string, text string")
    documents = spark.createDataFrame([("c", "d", "Cove\nAlso a cup: silver\nThe full Cove register list:\n- Bay\n- Cove\nBay | 9 boats\nCove | 12 boats")], "case_id string, document_id string, text string")
    chosen = spark.createDataFrame([("c", a, f"evidence:{a}:d:1", 1) for a in "abk"], "case_id string, atom_id string, premise_id string, place int")
    body = documents.first()["text"]
    at = body.index("Also")
    spans = spark.createDataFrame([("c", "k", "1", "d", "Also a cup: silver", at, at + 18)], "case_id string, atom_id string, span_id string, document_id string, text string, start_u16 int, end_u16 int")
    contexts = premises.context_premises(atoms, spans, documents)
    assert [r["text"] for r in contexts.collect()] == ["Cove\nAlso a cup: silver"]
    got = {(r["atom_id"], r["operator"]): r["premise_ids"] for r in premises.build_candidates(atoms, chosen, premises.list_premises(documents), premises.line_operands(documents), contexts).collect()}
    assert got["a", "SET_MEMBERSHIP"] == ["list:d:1:certificate", "list:d:1:item:2"]
    assert got["b", "EXTREMUM_COMPARE"] == ["evidence:b:d:1", "operand:d:line:7", "operand:d:line:6"]
    assert got["k", "COUNT_DISTINCT"] == ["evidence:k:d:1", "context-record:k:d:1"]


def test_scope_by_the_sources_beginning(spark):
    atoms = spark.createDataFrame([("c", "a", "Exports from Sweden rose.")], "case_id string, atom_id string, text string")
    spans = spark.createDataFrame([("c", "a", "s", "They rose.", None, "x.example", "A bulletin of Finland.")], "case_id string, atom_id string, span_id string, text string, title string, host string, document string")
    assert rules.scope_checks(atoms, spans).first()["status"] == "MISMATCH"
    assert rules.scope_checks(atoms, spans.withColumn("document", F.lit(None).cast("string"))).first()["status"] == "UNRESOLVED"


def test_names_meet_not_texts(spark):
    claims = spark.createDataFrame([("c", "a", "Lee spoke at WFB."), ("c", "b", "rain fell")], "case_id string, atom_id string, text string")
    texts = spark.createDataFrame([("c", "a", "d", "The World Food Board (WFB) met. Ann Lee spoke.")], "case_id string, atom_id string, document_id string, text string")
    found = identity.align(claims, identity.mentioned(texts, ["case_id", "atom_id", "document_id"]), identity.document_groups(texts, ["case_id", "document_id"]))
    assert {r["atom_id"]: r["status"] for r in found.collect()} == {"a": "ALIGNED", "b": "NOT_APPLICABLE"}


def test_entry_points(spark):
    claims = spark.createDataFrame([("c", "Rain fell on Bay. Cove stayed dry."), ("k", "Rain fell."), ("m", "x")], "case_id string, claim string")
    replies = spark.createDataFrame([("c", '{"atoms": [{"text": "Rain fell on Bay.", "sourceText": "Rain fell on Bay", "role": "CORE"}, {"text": "Cove stayed dry.", "sourceText": "Cove stayed dry"}], "composition": "AND"}'), ("k", "no json"), ("m", '{"atoms": []}')], "case_id string, reply string")
    atoms, rejected = api.decompose(claims, replies)
    assert [(r["case_id"], r["atom_id"], r["start_u16"], r["role"]) for r in atoms.orderBy("case_id", "atom_id").collect()] == [("c", "atom-1", 0, "CORE"), ("c", "atom-2", 18, "CORE")]
    assert {r["case_id"]: r["reason"] for r in rejected.collect()} == {"k": "MALFORMED_REPLY", "m": "NO_ATOMS"}


def test_executions_of_candidates(spark):
    from spanloom.operators import reasoning

    atoms = spark.createDataFrame([("c", "a", "Cove is listed on the register."), ("c", "b", "Gull is listed on the register."), ("c", "k", "Bay has at least 9 boats."), ("c", "m", "Ann Lee has at least 9 boats.")], "case_id string, atom_id string, text string")
    documents = spark.createDataFrame([("c", "d", "The full register of Cove and Gull list:\n- Bay\n- Cove")], "case_id string, document_id string, text string")
    evidence = spark.createDataFrame([("c", "e1", "d", "EVIDENCE", "Bay has 12 boats.", None), ("c", "e2", "d", "EVIDENCE", "Bob Ray, not Ann, has 12 boats.", None)], "case_id string, premise_id string, document_id string, kind string, text string, digest string")
    lists = premises.list_premises(documents)
    chosen = spark.createDataFrame([("c", "k", "e1", 1), ("c", "m", "e2", 1)], "case_id string, atom_id string, premise_id string, place int")
    found = premises.build_candidates(atoms, chosen, lists, premises.line_operands(documents))
    known = evidence.unionByName(lists.select(*evidence.columns))
    kinds = {"a": "SET_MEMBERSHIP", "b": "SET_MEMBERSHIP", "k": "NUMERIC_COMPARE", "m": "NUMERIC_COMPARE"}
    of = lambda rows: {r["atom_id"]: (r["status"], r["warning"]) for r in rows.collect() if r["operator"] == kinds[r["atom_id"]]}
    rows = reasoning.programs_of(reasoning.execute(atoms, found, known)).collect()
    got = {r["atom_id"]: (r["status"], r["warning"]) for r in rows if r["operator"] == kinds[r["atom_id"]]}
    # an item proves, a certified list disproves, amounts prove, and a proof about somebody else is none
    assert got == {"a": ("PROVED", None), "b": ("DISPROVED", None), "k": ("PROVED", None), "m": ("UNRESOLVED", "MISSING_ENTITY_ALIGNMENT")}
    mappings = found.where("atom_id = 'k' AND operator = 'NUMERIC_COMPARE'").select("case_id", "atom_id", "candidate_id", "premise_ids")
    got = of(reasoning.execute(atoms, found, known, mappings))
    assert got == {"k": ("PROVED", None), **{a: ("UNRESOLVED", "NO_GROUNDED_PROGRAM") for a in "abm"}}
    steps = next(r for r in rows if r["atom_id"] == "k" and r["operator"] == "NUMERIC_COMPARE")["program"]["steps"]
    assert [s["operation"] for s in steps] == ["LOOKUP", "COMPARE"]


def test_executions_on_numbers_of_any_length(spark):
    from spanloom.operators import reasoning

    atoms = spark.createDataFrame([("c", "k", "Bay has at least 9 boats.")], "case_id string, atom_id string, text string")
    candidates = spark.createDataFrame([("c", "k", "n", "NUMERIC_COMPARE", "x", ["e"])], "case_id string, atom_id string, candidate_id string, operator string, profile string, premise_ids array<string>")
    known = spark.createDataFrame([("c", "e", "d", "EVIDENCE", f"Bay has {'7' * 600} boats.", None)], "case_id string, premise_id string, document_id string, kind string, text string, digest string")
    out = reasoning.execute(atoms, candidates, known)
    assert [(r["status"], r["relation"]) for r in out.collect()] == [("PROVED", "SUPPORTS")]


def test_texts_that_come_once_are_not_moved(spark):
    rows = [("c", "d", "1 boat\n\n 🚨 2 boats "), ("c", "e", "x"), ("c", "e", "x"), ("c", "f", ""), ("c", "f", "3 boats"), (None, "g", "a 4"), (None, "g", "a 4"), ("c", "h", None)]
    documents = spark.createDataFrame(rows, "case_id string, document_id string, text string")
    found = premises.line_operands(documents)
    got = sorted((r["document_id"], r["premise_id"], r["text"], r["start_u16"], r["end_u16"]) for r in found.collect())
    assert got == [("d", "operand:d:line:1", "1 boat", 0, 6), ("d", "operand:d:line:2", "🚨 2 boats", 9, 19), ("f", "operand:f:line:1", "3 boats", 0, 7), ("g", "operand:g:line:1", "a 4", 0, 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1  # of repeated documents
