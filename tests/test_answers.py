"""Sub-scores and composites of answers against values worked out by hand."""

import pytest

from causeway.functions import lexicons as lx
from causeway.operators import evaluation

_ANSWERS = [
    (0, True, True, True, "the mechanism is electron doping that changes mobility", "a different path instead of this one", ["processing sets structure and causes order", "structure leads to mobility and concentration", "order enables mobility"],
     {"shift": "5 cm"}, {"mobility": "high"}, ["processing sets structure and order", "structure leads to mobility"], 2, 1, 4, 3, 0, 0.5, 0.6, 0.9, 0.4, 12, [0.7, 0.2, 0.1]),
    (1, True, False, True, "short", "", ["not one of these"], {}, {"band": "x"}, [], 0, 0, 0, 0, 0, None, 0.2, None, None, 0, [0.9]),
    (2, False, False, False, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
]
_ANSWER_SCHEMA = (
    "answer_id int, has_processing boolean, has_structure boolean, has_properties boolean, primary_mechanism string, alternatives string, steps array<string>, quantities map<string,string>, predictions map<string,string>, "
    "evidence array<string>, n_claims int, n_verified int, n_edges int, n_edges_verified int, n_grounded_steps int, alt_cosine double, prediction_cosine double, entailment double, source_diversity double, n_papers int, step_cosines array<double>"
)
#: Worked out by hand from the definitions of the sub-scores.
_EXPECTED = {
    0: dict(intervention_consistency=0.75, counterfactual_reasoning=1.0, mechanistic_modularity=1.0, psp_chain_validity=1.0, kg_verification=0.5, literature_entailment=0.86, multihop_grounding=2 / 3, source_diversity=0.4,
            sufficiency=1.0, comprehensiveness=1.0, logical_consistency=1.0, mechanistic_precision=1.0, forward_simulation=1.0, psp_consistency_score=1.0),
    1: dict(intervention_consistency=0.0, counterfactual_reasoning=0.0, mechanistic_modularity=0.0, psp_chain_validity=0.0, kg_verification=0.0, literature_entailment=0.0, multihop_grounding=0.0, source_diversity=0.0,
            sufficiency=0.0, comprehensiveness=0.0, logical_consistency=0.7, mechanistic_precision=0.0, forward_simulation=0.0, psp_consistency_score=0.2),
    2: dict(intervention_consistency=0.0, counterfactual_reasoning=0.0, mechanistic_modularity=0.0, psp_chain_validity=0.0, kg_verification=0.0, literature_entailment=0.0, multihop_grounding=0.0, source_diversity=0.0,
            sufficiency=0.0, comprehensiveness=0.0, logical_consistency=1.0, mechanistic_precision=0.0, forward_simulation=0.0, psp_consistency_score=0.0),
}


def test_scores_by_hand(spark):
    got = {r.answer_id: r for r in evaluation.answer_metrics(spark.createDataFrame(_ANSWERS, _ANSWER_SCHEMA)).collect()}
    for i, own in _EXPECTED.items():
        parts = [sum(w * own[k] for k, w in weights.items()) for weights in (lx.COHERENCE_WEIGHTS, lx.GROUNDING_WEIGHTS, lx.VALIDITY_WEIGHTS)]
        whole = {**own, "causal_coherence_score": parts[0], "source_grounding_score": parts[1], "internal_validity_score": parts[2], "overall_score": (sum(parts) + own["psp_consistency_score"]) / 4}
        assert {k: got[i][k] for k in whole} == pytest.approx(whole)
