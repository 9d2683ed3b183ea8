"""Column types, vocabularies and constants of the pitch table."""

from __future__ import annotations

from pyspark.sql import types as T

LONGS = "game_pk batter pitcher on_1b on_2b on_3b umpire".split()
INTS = "at_bat_number pitch_number".split()
BYTES = "balls strikes outs_when_up inning zone hit_location launch_speed_angle".split()
DOUBLES = (
    "spin_dir spin_rate_deprecated break_angle_deprecated break_length_deprecated tfs_deprecated release_speed release_pos_x "
    "release_pos_y release_pos_z release_extension release_spin_rate pfx_x pfx_z plate_x plate_z sz_top sz_bot hc_x hc_y vx0 vy0 "
    "vz0 ax ay az effective_speed launch_speed launch_angle hit_distance_sc estimated_ba_using_speedangle "
    "estimated_woba_using_speedangle estimated_slg_using_speedangle woba_denom pitcher_days_since_prev_game "
    "batter_days_since_prev_game pitcher_days_until_next_game batter_days_until_next_game api_break_z_with_gravity "
    "api_break_x_arm api_break_x_batter_in spin_axis bat_speed swing_length attack_angle attack_direction swing_path_tilt "
    "intercept_ball_minus_batter_pos_x_inches intercept_ball_minus_batter_pos_y_inches arm_angle miss_distance hyper_speed"
).split()
PINNED = {c: T.LongType() for c in LONGS} | {c: T.IntegerType() for c in INTS} | {c: T.ByteType() for c in BYTES} | {c: T.DoubleType() for c in DOUBLES} | {"tfs_zulu_deprecated": T.StringType()}
PITCH_KEY = ["game_pk", "at_bat_number", "pitch_number"]

SWINGS = "foul hit_into_play swinging_strike swinging_strike_blocked foul_tip foul_bunt missed_bunt bunt_foul_tip".split()
WHIFFS = "swinging_strike swinging_strike_blocked missed_bunt".split()
CALLED = ["called_strike"]
NON_PITCH = "automatic_ball automatic_strike".split()
NON_COMPETITIVE = "pitchout intent_ball".split()
TAKES = "ball called_strike blocked_ball".split()
NO_RUN_VALUE = "intent_walk catcher_interf truncated_pa game_advisory".split()

PITCH_TYPES = "FF SI FC SL ST CU KC SV CH FS KN EP FA CS SC".split()
PRIOR_TYPES = "FF SI FC SL ST CU KC CH FS".split()
FAMILIES = {"fastball": "FF SI FC FA".split(), "breaking": "SL ST CU KC SV CS SC".split(), "offspeed": "CH FS KN EP".split()}
COUNT_BUCKETS = {
    "0-0": "first", "0-1": "ahead", "2-1": "ahead", "0-2": "putaway", "1-2": "putaway", "2-2": "even_deep", "1-0": "behind",
    "2-0": "behind", "3-0": "must_strike", "3-1": "must_strike", "1-1": "even", "3-2": "full",
}
#: Name: (low, high, low is open). Measurements beyond are impossible.
LIMITS = {"release_speed": (25, 108, False), "plate_x": (-15, 15, False), "plate_z": (-10, 20, False), "release_pos_z": (0, 10, True), "release_pos_x": (-8, 8, False)}
ZONE_HALF_WIDTH = 0.83
SATURATED_ROWS, ROW_CAP = 24_900, 25_000

STUFF = "release_speed ivb_in hb_arm_in release_spin_rate spin_axis_sin spin_axis_cos release_extension release_pos_x_arm release_pos_z arm_angle velo_diff_fb ivb_diff_fb hb_diff_fb is_platoon_same".split()
LOCATION = "plate_x_out plate_z plate_z_norm balls strikes pitch_type is_platoon_same".split()
CLUSTER = "release_speed ivb_in hb_arm_in spin_axis_sin spin_axis_cos".split()
NEXT_PITCH = (
    "balls strikes outs_when_up inning base_state base_out_state score_diff is_platoon_same stand p_throws pitch_count_in_game "
    "n_thruorder_pitcher pitcher_days_since_prev_game pitch_in_ab prev_pitch_type_1 prev_pitch_type_2 prev_pitch_type_3 "
    "prev_plate_x_1 prev_plate_z_norm_1 prev_was_swing_1 prev_was_whiff_1 prev_was_in_zone_1 prev_velo_1 "
    "last_pitch_type_vs_batter prior_usage_ff prior_usage_si prior_usage_fc prior_usage_sl prior_usage_st prior_usage_cu "
    "prior_usage_kc prior_usage_ch prior_usage_fs prior_usage_ff_family prior_usage_breaking prior_usage_offspeed "
    "prior_zone_rate prior_pitches_seen prior_usage_this_count home_team is_home_pitching"
).split()
#: Columns that describe the pitch itself: never features of a prediction made before it.
FORBIDDEN = "pitch_type release_speed plate_x plate_z plate_z_norm description events delta_run_exp is_swing is_whiff is_in_zone is_called_strike is_in_play launch_speed launch_angle zone".split()
