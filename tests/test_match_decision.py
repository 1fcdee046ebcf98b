"""Literal cases of fuzzy match decisions."""

from prospectra.operators import similarity
from prospectra.plans import presence

ENT = "entity_id int, name string, postcode string, city string, region string, latitude double, longitude double"
CAND = "entity_id int, candidate_id int, c_name string, address string, c_postcode string, c_city string, c_region string, c_latitude double, c_longitude double"


def test_decisions(spark):
    here = (28.0, -97.0)
    ent = [(i, "Blue Harbor Bakery", "78382-1000", "Rockport", "TX", *here) for i in range(1, 8)] + [(8, "The Shop", None, None, None, None, None)]
    cand = [
        (1, 10, "Blue Harbor Bakery", None, None, None, None, *here),  # distance alone: full place score
        (2, 20, "Blue Harbor Bakery", None, None, None, None, None, None),  # no place evidence
        (3, 30, "Blue Harbor Bakery", "", "78382", "Rockport", "TX", 40.0, -97.0),  # structured address alone
        (4, 40, "Zzz Qqq", None, None, None, None, None, None),  # neither score nor agreement: below the threshold
        (6, 60, "Blue Harbor Bakery", None, None, None, None, 28.02, -97.0),  # 2.2 km
        (7, 70, "Blue Harbor Bakery", "78382 Elm St", "99999", None, None, None, None),  # a house number is no zip
        (8, 80, "The Shop", None, None, None, None, None, None),  # equal, but no telling word
    ]
    e, c = spark.createDataFrame(ent, ENT), spark.createDataFrame(cand, CAND)
    got = {r["entity_id"]: r for r in presence.decide(e, similarity.score_candidates(e.join(c, "entity_id"))).collect()}
    yes, low, none = "binary_score_at_or_above_threshold", "binary_score_below_threshold", "search_returned_no_candidates"
    want = {1: (1.0, True, yes), 2: (0.85, True, yes), 3: (1.0, True, yes), 5: (None, False, none), 6: (0.94, True, yes), 7: (0.85, True, yes), 8: (0.85, False, "no_meaningful_name_agreement")}
    for i, w in want.items():
        assert (got[i]["score"], got[i]["matched"], got[i]["reason"]) == w, i
    assert (got[4]["matched"], got[4]["reason"]) == (False, low) and got[5]["candidate_id"] is None
