"""Binary classifiers: every ``model_*`` fits on a training table and
returns the evaluation table scored as (id, label, score = P(positive))."""
