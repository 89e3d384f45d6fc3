"""Table schemas, the feature registry and the fixed values the operators share."""

from __future__ import annotations

from pyspark.sql import types as T


TEXT, LONG, INT, DOUBLE, BOOL, TIME = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType())


def _struct(*groups: tuple[T.DataType, str]) -> T.StructType:
    """A schema from (type, "name name ...") groups, in order; needs no session."""
    return T.StructType([T.StructField(name, kind) for kind, names in groups for name in names.split()])


# ---------------------------------------------------------------------------
# Feature registry.
# ---------------------------------------------------------------------------
NUMERICAL = [
    "age", "experience_years", "initial_investment", "monthly_rent",
    "store_size_sqm", "employee_count", "nearby_competitor_count", "initial_capital",
]
CATEGORICAL = [
    "gender", "education_level", "business_category",
    "business_sub_category", "district", "floating_population_level",
]
BINARY = ["has_related_experience", "has_startup_experience", "is_franchise"]
TARGETS = [
    "survival_1yr", "survival_3yr", "monthly_revenue",
    "monthly_profit", "risk_score", "break_even_months",
]
DERIVED = [
    "rent_burden_ratio", "investment_per_sqm", "investment_per_person",
    "is_high_competition", "is_young", "is_senior", "inexperienced_independent",
]
FEATURES = NUMERICAL + CATEGORICAL + BINARY + DERIVED

# Defaults for model columns a frame does not have.
ABSENT_DEFAULTS = {
    "age": 35,
    "experience_years": 3,
    "initial_investment": 50_000_000,
    "initial_capital": 50_000_000,
    "monthly_rent": 2_000_000,
    "store_size_sqm": 33.0,
    "employee_count": 1,
    "nearby_competitor_count": 5,
    "gender": "M",
    "education_level": "bachelor",
    "floating_population_level": "medium",
    "has_related_experience": 0,
    "has_startup_experience": 0,
    "is_franchise": 0,
}

# Names in the store API and in the tables -> model names.
API_TO_MODEL = {
    "indsLclsCdNm": "business_category",
    "indsLclsNm": "business_category",
    "indsMclsCdNm": "business_sub_category",
    "indsMclsNm": "business_sub_category",
    "adongNm": "district",
    "adongCd": "dong_code",
    "lon": "longitude",
    "lat": "latitude",
    "bizesNm": "store_name",
    "bizesId": "biz_id",
    "rdnmAdr": "road_address",
    "lnoAdr": "lot_address",
}
TABLE_TO_MODEL = {
    "category_large": "business_category",
    "category_mid": "business_sub_category",
    "adong_name": "district",
    "adong_cd": "dong_code",
}

# Names in the store and status APIs -> ``stores`` columns.
# ``stdrYm`` is added here: without it ``data_ym`` could never be filled.
API_TO_TABLE = {
    "bizesId": "biz_id",
    "bizesNm": "store_name",
    "brchNm": "branch_name",
    "indsLclsCd": "category_large_cd",
    "indsLclsCdNm": "category_large",
    "indsLclsNm": "category_large",
    "indsMclsCd": "category_mid_cd",
    "indsMclsCdNm": "category_mid",
    "indsMclsNm": "category_mid",
    "indsSclsCd": "category_small_cd",
    "indsSclsCdNm": "category_small",
    "indsSclsNm": "category_small",
    "ksicCd": "ksic_cd",
    "ksicNm": "ksic_name",
    "ctprvnCd": "sido_cd",
    "ctprvnNm": "sido_name",
    "signguCd": "sgg_cd",
    "signguNm": "sgg_name",
    "adongCd": "adong_cd",
    "adongNm": "adong_name",
    "ldongCd": "ldong_cd",
    "ldongNm": "ldong_name",
    "lnoAdr": "lot_address",
    "rdnmAdr": "road_address",
    "bldNm": "building_name",
    "nwZipCd": "zip_code",
    "lon": "longitude",
    "lat": "latitude",
    "flrNo": "floor_info",
    "hoNo": "unit_info",
    "b_stt_cd": "biz_status_cd",
    "b_stt": "biz_status",
    "end_dt": "closure_date",
    "stdrYm": "data_ym",
}
REGION_TO_TABLE = {
    "sido_nm": "sido_name",
    "sgg_nm": "sgg_name",
    "dong_nm": "dong_name",
    "full_nm": "full_name",
}

# Status codes. 01 trading, 02 suspended, 03 closed.
ACTIVE, SUSPENDED, CLOSED = "01", "02", "03"
STATUS_NAMES = {"01": "영업중", "02": "휴업", "03": "폐업"}

# Keyword synonyms for category search.
CATEGORY_SYNONYMS = {
    "food": "음식",
    "retail": "소매",
    "service": "서비스",
    "education": "교육",
    "it": "정보통신",
    "medical": "의료",
    "cafe": "음식",
    "restaurant": "음식",
    "카페": "음식",
}

# Provinces and their two-digit codes.
PROVINCES = {
    "서울특별시": "11", "부산광역시": "26", "대구광역시": "27", "인천광역시": "28",
    "광주광역시": "29", "대전광역시": "30", "울산광역시": "31", "세종특별자치시": "36",
    "경기도": "41", "강원특별자치도": "42", "충청북도": "43", "충청남도": "44",
    "전북특별자치도": "45", "전라남도": "46", "경상북도": "47", "경상남도": "48",
    "제주특별자치도": "50",
}

# District codes inside the capital.
CAPITAL_DISTRICTS = {
    "110": "종로구", "140": "중구", "170": "용산구", "200": "성동구", "215": "광진구",
    "230": "동대문구", "260": "중랑구", "290": "성북구", "305": "강북구", "320": "도봉구",
    "350": "노원구", "380": "은평구", "410": "서대문구", "440": "마포구", "470": "양천구",
    "500": "강서구", "530": "구로구", "545": "금천구", "560": "영등포구", "590": "동작구",
    "620": "관악구", "650": "서초구", "680": "강남구", "710": "송파구", "740": "강동구",
}

# ---------------------------------------------------------------------------
# Tables.
# ---------------------------------------------------------------------------
_STORE_TEXT = (
    "biz_id store_name branch_name category_large_cd category_large category_mid_cd category_mid "
    "category_small_cd category_small ksic_cd ksic_name sido_cd sido_name sgg_cd sgg_name adong_cd adong_name "
    "ldong_cd ldong_name lot_address road_address building_name zip_code"
)
_LONGITUDE, _LATITUDE = (T.DecimalType(11, 8), "longitude"), (T.DecimalType(10, 8), "latitude")
STORES = _struct(
    (TEXT, _STORE_TEXT), _LONGITUDE, _LATITUDE,
    (TEXT, "floor_info unit_info biz_status_cd biz_status closure_date data_ym"), (TIME, "collected_at updated_at"),
)
REGION_CODES = _struct((TEXT, "region_cd region_cd_8 sido_cd sgg_cd dong_cd sido_name sgg_name dong_name full_name"))
COLLECTION_LOGS = _struct((TEXT, "dong_cd dong_name"), (LONG, "store_count"), (TEXT, "status error_msg"), (TIME, "collected_at"))
_CLEAN = (
    (TEXT, "biz_id store_name business_category business_sub_category district dong_code"), _LONGITUDE, _LATITUDE,
    (TEXT, "road_address lot_address"), (INT, "age experience_years"),
    (LONG, "initial_investment initial_capital monthly_rent"), (DOUBLE, "store_size_sqm"),
    (INT, "employee_count nearby_competitor_count"), (TEXT, "gender education_level floating_population_level"),
    (INT, "has_related_experience has_startup_experience is_franchise"), (TEXT, "biz_status_cd"),
)
CLEANED_STORES = _struct(*_CLEAN, (TEXT, "biz_status closure_date pipeline_run_id"), (TIME, "cleaned_at"))
LABELED_STORES = _struct(
    *_CLEAN, (DOUBLE, "survival_1yr survival_3yr"), (LONG, "monthly_revenue monthly_profit"), (DOUBLE, "risk_score"),
    (INT, "break_even_months"), (TEXT, "pipeline_run_id"), (TIME, "labeled_at"),
)
FEATURE_SET_META = _struct(
    (TEXT, "pipeline_run_id"), (T.ArrayType(TEXT), "feature_columns target_columns"), (LONG, "n_samples"),
    (INT, "n_features n_targets"), (T.MapType(TEXT, T.ArrayType(DOUBLE)), "scaler_params"),
    (T.MapType(TEXT, T.ArrayType(TEXT)), "encoder_classes"), (LONG, "source_row_count"), (TIME, "created_at"),
)
RUN_EVENTS = _struct(
    (TEXT, "run_id pipeline_run_id model_type status"), (LONG, "train_size val_size test_size n_features"),
    (T.MapType(TEXT, DOUBLE), "metrics"), (TEXT, "model_path artifacts_path error_message"), (TIME, "event_ts"),
)
_ITEM = T.StructType([
    T.StructField(name, DOUBLE if name in ("lon", "lat") else TEXT)
    for name in API_TO_TABLE if not name.startswith("b_") and name != "end_dt"
])
STORE_PAGE = _struct((LONG, "page"), (_struct((T.ArrayType(_ITEM), "items")), "body"))
STATUS_PAGE = _struct((LONG, "page"), (T.ArrayType(_struct((TEXT, "b_no b_stt b_stt_cd end_dt"))), "data"))
REGION_PAGE = _struct(
    (_struct((LONG, "totalCount pageNo numOfRows"), (TEXT, "request")), "head"),
    (T.ArrayType(_struct((TEXT, "region_cd sido_cd sgg_cd umd_cd ri_cd locatadd_nm locat_rm"))), "row"),
)
REGION_FILE = _struct((TEXT, "region_cd region_cd_8 sido_cd sgg_cd dong_cd sido_nm sgg_nm dong_nm full_nm"))
REQUESTS = _struct(
    (TEXT, "request_id"), (LONG, "founder_age"), (TEXT, "founder_gender founder_education"), (LONG, "experience_years"),
    (BOOL, "has_related_experience"), (TEXT, "business_category business_sub_category"),
    (LONG, "initial_investment monthly_rent"), (DOUBLE, "store_size_sqm"), (LONG, "employee_count"), (BOOL, "is_franchise"),
    (TEXT, "district"),
)
