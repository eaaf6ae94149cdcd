import pytest

from threadmill.functions import fixed_values as V
from threadmill.operators import closure

P = [("C", "My offline songs vanished"), ("B", "Please reinstall the player.")]
O = ("C", "My offline songs vanished")
CASES = [
    (P + [("C", "Cheers, got it")], "resolved", "customer_resolved"),
    (P + [("C", "That worked")], "resolved", "customer_resolved"),
    (P + [("C", "Thanks but it keeps crashing, any update")], "unresolved", "customer_continues"),
    (P + [("C", "It hasn’t been fixed")], "unresolved", "customer_continues"),
    ([O, ("B", "Drop us a DM"), ("C", "Thank you")], None, "customer_dm_ack"),
    ([O, ("B", "Drop us a DM"), ("C", "Works fine, thank you")], "resolved", "customer_resolved"),
    (P + [("C", "DMed you the details")], None, "customer_dm"),
    (P + [("C", "Okay, on Tuesday then")], None, "customer_unclear"),
    (P + [("C", "Thanks anyway")], None, "customer_unclear"),
    (P + [("C", "Thanks for the long story about my weekend and the new speakers that arrived on Monday morning")], None, "customer_unclear"),
    ([O, ("B", "We've fixed that, DM us for details")], "resolved", "brand_completion"),
    ([O, ("B", "Over to DM for the account details")], None, "brand_dm"),
    ([O, ("B", "Unfortunately that album was removed")], "unresolved", "brand_refusal"),
    ([O, ("B", "We can't wait to hear more")], "uncertain", "brand_silence"),
    (P + [("C", "Thanks a lot"), ("B", "Anytime, enjoy the music")], "resolved", "brand_ack_close"),
    (P + [("C", "Thanks a lot"), ("B", "Great! Let us know if you need anything else")], "resolved", "brand_ack_close"),
    (P + [("C", "Thanks a lot"), ("B", "Could you tell us the model")], "uncertain", "brand_question"),
    (P + [("C", "Thanks a lot"), ("B", "We'll look into it")], "uncertain", "brand_followup"),
    ([("C", "Thanks for nothing changing"), ("B", "Enjoy the music")], "uncertain", "brand_silence"),
    ([O, ("B", "Which phone is it?")], "uncertain", "brand_question"),
    ([O, ("B", "We'll look into it")], "uncertain", "brand_followup"),
    (P, "uncertain", "brand_silence"),
]


@pytest.fixture(scope="module")
def labels(spark):
    side = {"C": "customer", "B": "brand"}
    rows = [(i, [(side[s], t) for s, t in turns]) for i, (turns, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "interaction_id long, turns array<struct<side:string,text:string>>")
    return {r["interaction_id"]: r for r in closure.label_interactions(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules(labels, i):
    _, label, reason = CASES[i]
    assert (labels[i]["label"], labels[i]["reason"]) == (label, V.REASONS[reason])
    assert labels[i]["needs_adjudication"] == (label is None) == (reason in V.FLAGS)
