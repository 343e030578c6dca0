from sceneloom.plans.signals import triple_scores
from sceneloom.runtime import table


def test_every_candidate_is_scored(spark):
    sf = "/root/testdata/sf0.001"
    want = table(spark, sf, "scored_candidates").where("c_src is not null and c_tgt is not null and rst_type is not null").count()
    assert sum(r.n for r in triple_scores(spark, sf).collect()) == want
