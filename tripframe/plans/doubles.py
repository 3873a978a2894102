"""Double-typed result columns per oracle query (generated by
tests/test_doubles.py::regenerate; checked by the same test)."""

DOUBLE_COLUMNS = {
    'banded_comparison': ['Actual', 'Predicted', 'Absolute Error'],
    'banded_comparison_holding': ['Actual', 'Predicted', 'Absolute Error'],
    'bin_drilldown': ['EVENT_MIN', 'DIFF_EVENT_AI', 'DIFF_EVENT_BIS'],
    'boost_features': ['LEN_mm', 'dep_time_sin', 'dep_time_cos', 'log_len'],
    'bucket_collisions': ['mean_ids_per_bucket'],
    'bundle_score': ['prediction'],
    'clamp_outliers': ['TIME_GAP'],
    'clip_zero': ['centred', 'clipped'],
    'corr_matrix': ['corr'],
    'cyclic': ['dep_time_sin', 'dep_time_cos', 'day_type_sin', 'day_type_cos'],
    'derived_speed': ['speed_kmh'],
    'describe_mixed': ['mean', 'std', 'min', 'p25', 'p50', 'p75', 'max'],
    'describe_num': ['mean', 'std', 'min', 'p25', 'p50', 'p75', 'max'],
    'drop_audit': ['pct_dropped'],
    'feature_matrix': ['LEN_scaled', 'dep_time_sin', 'dep_time_cos', 'log_len'],
    'fence_summary': ['lower_bound', 'upper_bound'],
    'fit_table_roundtrip': ['LEN_scaled', 'TIME_GAP_scaled'],
    'flagship_tod_profile': ['mean_time_gap'],
    'histogram': ['lo', 'hi'],
    'holding_features': ['dep_time_sin', 'dep_time_cos'],
    'improvement': ['ai_mean', 'bis_mean', 'improvement_pct'],
    'impute': ['LEN', 'SPEED'],
    'iqr_stats': ['pct'],
    'log_len': ['log_len', 'log_route_len'],
    'metrics_batch': ['mae', 'rmse', 'mape'],
    'metrics_global': ['mae', 'mse', 'rmse', 'mape'],
    'metrics_json_roundtrip': ['mae', 'mse', 'rmse', 'mape'],
    'minmax': ['LEN_mm', 'TIME_GAP_mm'],
    'minmax_group': ['LEN_mm', 'TIME_GAP_mm'],
    'onehot_day': ['day_1', 'day_2', 'day_3', 'day_4', 'day_5', 'day_6', 'day_7'],
    'onehot_type': ['EVENT', 'PATRN'],
    'per_group_regression': ['prediction'],
    'per_group_regression_multi': ['prediction'],
    'prediction_report': ['prediction', 'ERROR_RATE'],
    'random_rows': ['Actual', 'Predicted', 'Absolute Error'],
    'report_variants': ['TIME_GAP_ESTIMATE', 'MAE'],
    'route_feat_features': ['day_1', 'day_2', 'day_3', 'day_4', 'day_5', 'day_6', 'day_7', 'LEN_scaled', 'PEEK_ALLOC_scaled', 'NPEEK_ALLOC_scaled', 'BUSSTOP_CNT_scaled', 'INFOUNIT_SEQ_scaled', 'GPS_COORDX_scaled', 'GPS_COORDY_scaled', 'LOG_ROUTE_LEN_scaled', 'dep_time_sin', 'dep_time_cos', 'day_type_sin', 'day_type_cos', 'log_len'],
    'route_features': ['day_1', 'day_2', 'day_3', 'day_4', 'day_5', 'day_6', 'day_7', 'LEN_scaled', 'dep_time_sin', 'dep_time_cos', 'day_type_sin', 'day_type_cos', 'log_len'],
    'score_without_actuals': ['prediction'],
    'sequence_weight': ['weight'],
    'speed_outlier_list': ['SPEED'],
    'speed_outliers': ['SPEED'],
    'split_report': ['ratio'],
    'standard_inverse': ['TIME_GAP_restored'],
    'standard_scale': ['LEN_scaled', 'TIME_GAP_scaled'],
    'standard_scale_per_set': ['LEN_scaled'],
    'step_sequences': ['DAY_TYPE_1', 'DAY_TYPE_2', 'DAY_TYPE_3', 'DAY_TYPE_4', 'DAY_TYPE_5', 'dep_hour_1', 'dep_hour_2', 'dep_hour_3', 'dep_hour_4', 'dep_hour_5', 'dep_minute_1', 'dep_minute_2', 'dep_minute_3', 'dep_minute_4', 'dep_minute_5', 'LEN_mm_1', 'LEN_mm_2', 'LEN_mm_3', 'LEN_mm_4', 'LEN_mm_5', 'dep_time_sin_1', 'dep_time_sin_2', 'dep_time_sin_3', 'dep_time_sin_4', 'dep_time_sin_5', 'dep_time_cos_1', 'dep_time_cos_2', 'dep_time_cos_3', 'dep_time_cos_4', 'dep_time_cos_5', 'day_type_sin_1', 'day_type_sin_2', 'day_type_sin_3', 'day_type_sin_4', 'day_type_sin_5', 'day_type_cos_1', 'day_type_cos_2', 'day_type_cos_3', 'day_type_cos_4', 'day_type_cos_5', 'log_len_1', 'log_len_2', 'log_len_3', 'log_len_4', 'log_len_5', 'is_weekend_1', 'is_weekend_2', 'is_weekend_3', 'is_weekend_4', 'is_weekend_5', 'time_of_day_1', 'time_of_day_2', 'time_of_day_3', 'time_of_day_4', 'time_of_day_5', 'peak_hours_1', 'peak_hours_2', 'peak_hours_3', 'peak_hours_4', 'peak_hours_5', 'distance_type_1', 'distance_type_2', 'distance_type_3', 'distance_type_4', 'distance_type_5'],
    'stream_score': ['prediction'],
    'stream_window_means': ['mean_time_gap'],
    'target_weight_train': ['TIME_GAP_scaled', 'w_target'],
    'time_profile': ['mean', 'moving_mean'],
    'to_minutes': ['TIME_GAP_MIN'],
    'token_features': ['h0', 'h1', 'h2', 'h3'],
    'weighted_mse': ['weighted_mse'],
    'weights': ['w_travel', 'w_route_feat', 'w_route', 'w_legacy', 'w_data_type', 'w_target'],
}
