from opsrisk import schema as S


def test_rule_defaults_and_labels():
    cfg = S.RuleConfig()
    assert (cfg.sla_warning_threshold, cfg.high_error_threshold, cfg.high_rework_rate, cfg.high_manual_ratio,
            cfg.low_automation_threshold, cfg.backlog_threshold) == (0.80, 5, 0.10, 0.70, 0.30, 100)
    assert S.RISK_LABELS == ("low", "medium", "high")
    assert S.FEATURE_COLUMNS == S.NUMERIC_FEATURES + S.CATEGORICAL_FEATURES
    assert not set(S.FEATURE_COLUMNS) & set(S.LEAKAGE_COLUMNS)
    assert set(S.CATEGORY_BY_RULE) == set(S.RECOMMENDED_ACTIONS)
    assert [f.name for f in S.WORKFLOW_SCHEMA.fields] == list(S.REQUIRED_COLUMNS)
