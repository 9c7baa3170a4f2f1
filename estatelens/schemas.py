"""Tables: columns, types, and the names they carry in the source database."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    # stored figures; a database table has narrower ones, see sinks.DATABASE_TYPES
    "area": T.DecimalType(28, 2),
    "land": T.DecimalType(28, 3),
    # as read: nothing is rounded before it is banded, and sums are exact in any order
    "exact": T.DecimalType(28, 8),
}


def _schema(spec: str) -> T.StructType:
    """'a b:string, c:int' as a StructType."""
    fields = []
    for group in spec.split(","):
        names, kind = group.strip().split(":")
        fields += [T.StructField(n, _TYPES[kind]) for n in names.split()]
    return T.StructType(fields)


# --- inputs of the batch pipeline -------------------------------------------
SALE_DAILY = _schema(
    "region permit record_name category_raw:string, units:long, area:exact, date:date"
)
SUPPLY_RAW = _schema(
    "permit record_name region:string, open_date:date, area:exact, "
    "total_units for_sale non_sale:long, res_price com_price:exact"
)
PROMO = _schema("permit promo_name:string")
ROOM_PRICE = _schema("permit record_name remark:string, area total_price:exact")
PROJECT_INFO = _schema(
    "permit record_name delivery manager:string, land_area:land, "
    "volume far green presale:string"
)

# --- outputs of the batch pipeline ------------------------------------------
DEAL_LIST = _schema(
    "region permit record_name:string, units:long, area:area, date:date, "
    "res_price:area, promo_name category band:string"
)
HISTORY_SUPPLY = _schema(
    "permit region:string, area:area, record_name:string, open_date:date, "
    "total_units for_sale non_sale:long, res_price com_price:area, "
    "promo_name delivery manager:string, land_area:land, "
    "volume far green presale band:string"
)
REGION_RATIO = _schema("date:date, region:string, units total_units for_sale non_sale:long")
REGION_BAND_RATIO = _schema(
    "date:date, region band:string, units total_units for_sale non_sale:long"
)
REGION_BAND_STOCK = _schema(
    "date:date, region band:string, units:long, area_x:area, for_sale:long, "
    "area_y:area, total_units non_sale:long, area:area"
)

# --- further inputs of the report layer -------------------------------------
PROJECT_NAME = _schema("record_name promo_name region:string, open_date:date, units:int, area:double")
ROOM = _schema(
    "promo_name record_name:string, sale_date:date, building room_no status:string, "
    "area unit_price:double"
)
LAND = _schema(
    "status district parcel_name parcel_no location land_use list_start list_end "
    "deposit_end auction_start end_date terminate_date signup_start signup_end "
    "deal_time winner:string, site_area:double, far:string, "
    "max_far res_area com_area gfa start_price deal_price:double, "
    "density green detail_url:string"
)
# parcels with real dates; stored twice, see plans.parcels
LAND_DATES = (
    "deal_time", "auction_start", "list_start", "list_end", "deposit_end",
    "end_date", "terminate_date", "signup_start", "signup_end",
)
PARCELS = T.StructType([
    T.StructField(f.name, T.DateType() if f.name in LAND_DATES else f.dataType) for f in LAND
])
SECOND_HAND = _schema("date region:string, units:long, area:double")
LAND_MONTH = _schema("date:string, count:long, area change:double")
LAND_RATIO_MONTH = _schema("date:string, supply_deal_ratio:double")
LAND_CHANGE = _schema("date:string, value previous change:double")
LAND_PRICE_PAIR = _schema("date:string, floor_price res_floor_price:double")
LAND_SUPPLY_DEAL = _schema("date:string, supply deal ratio:double")
LAND_DISTRICT_CHANGE = _schema("date district:string, value previous change:double")
MONEY = _schema("riqi:date, m1 m2:double")
RESERVE_RATIO = _schema("date:date, large small_medium:double")
LENDING_RATE = _schema("date:date, rate:double")
INCOME = _schema("date:date, urban rural:double")
INCOME_DETAIL = _schema("riqi:date, region:string, urban:double")
CPI_PAIR = _schema("riqi:date, national city:double")
CPI = _schema("date:date, loan m2:double")
CITY_POPULATION = _schema("date:date, population urban_share gdp:double")
PEOPLE = _schema("date:date, region:string, population urban_pop gdp:double")

# --- fixed values: table and column names in the source database ------------
# canonical table name -> (source table, {source column: canonical column})
SOURCE_TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "sale_daily": ("房管网_每日数据详细", {
        "所在地区": "region", "预售证号": "permit", "项目名称": "record_name",
        "类别": "category_raw", "套数": "units", "建筑面积": "area", "日期": "date",
    }),
    "supply_raw": ("房管网_销售项目2层_供应房源数据", {
        "预售许可证号": "permit", "项目名称": "record_name", "所在地区": "region",
        "开盘日期": "open_date", "项目测算面积": "area", "房源总量": "total_units",
        "待售房源": "for_sale", "非销售房产": "non_sale",
        "住宅均价(元/㎡)": "res_price", "商业均价(元/㎡)": "com_price",
    }),
    "promo": ("推广名", {"预售许可证号": "permit", "项目推广名": "promo_name"}),
    "room_price": ("价格", {
        "预售许可证": "permit", "项目名称": "record_name", "备注": "remark",
        "建筑面积（㎡）": "area", "毛坯销售房屋总价（元）": "total_price",
    }),
    "project_info": ("房管网_销售项目2层_已清洗", {
        "预售许可证号": "permit", "项目名称": "record_name",
        "交付时间/竣工时间": "delivery", "物业公司": "manager", "占地面积": "land_area",
        "总建筑体量": "volume", "容积率": "far", "绿地率/绿化率": "green",
        "预售商品房": "presale",
    }),
    "deal_list": ("楼盘成交排行榜_python", {
        "所在地区": "region", "预售许可证号": "permit", "项目备案名": "record_name",
        "套数": "units", "建筑面积": "area", "日期": "date",
        "住宅均价(元/㎡)": "res_price", "项目推广名": "promo_name",
        "类别_2": "category", "面积段": "band",
    }),
    "history_supply": ("历史供应数据_python", {
        "预售许可证号": "permit", "所在地区": "region", "项目测算面积": "area",
        "项目名称": "record_name", "开盘日期": "open_date", "房源总量": "total_units",
        "待售房源": "for_sale", "非销售房产": "non_sale",
        "住宅均价(元/㎡)": "res_price", "商业均价(元/㎡)": "com_price",
        "项目推广名": "promo_name", "交付时间/竣工时间": "delivery",
        "物业公司": "manager", "占地面积": "land_area", "总建筑体量": "volume",
        "容积率": "far", "绿地率/绿化率": "green", "预售商品房": "presale",
        "面积段": "band",
    }),
    "region_ratio": ("各区域供销比_python", {
        "日期": "date", "所在地区": "region", "套数": "units", "房源总量": "total_units",
        "待售房源": "for_sale", "非销售房产": "non_sale",
    }),
    "region_band_ratio": ("各区域供销比_面积段_python", {
        "日期": "date", "所在地区": "region", "面积段": "band", "套数": "units",
        "房源总量": "total_units", "待售房源": "for_sale", "非销售房产": "non_sale",
    }),
    "region_band_stock": ("各区域库存_python", {
        "日期": "date", "所在地区": "region", "面积段": "band", "套数": "units",
        "建筑面积_x": "area_x", "待售房源": "for_sale", "建筑面积_y": "area_y",
        "房源总量": "total_units", "非销售房产": "non_sale", "项目测算面积": "area",
    }),
    "project_name": ("项目推广名称_view_task", {
        "项目名称": "record_name", "项目推广名": "promo_name", "所在地区": "region",
        "开盘日期": "open_date", "套数": "units", "面积": "area",
    }),
    "room": ("楼盘房源详情修改_python", {
        "项目推广名": "promo_name", "项目名称": "record_name", "销售日期": "sale_date",
        "幢名": "building", "室号": "room_no", "属性": "status", "总建筑面积": "area",
        "单价": "unit_price",
    }),
    "land": ("土地网_view_task", {
        "地块状态": "status", "所属行政区": "district", "地块名称": "parcel_name",
        "X.地块编号": "parcel_no", "地块位置": "location", "土地用途": "land_use",
        "挂牌开始时间": "list_start", "挂牌截止时间": "list_end",
        "保证金截止时间": "deposit_end", "拍卖开始时间": "auction_start",
        "结束时间": "end_date", "终止时间": "terminate_date",
        "报名开始时间.拍卖.": "signup_start", "报名截止时间.拍卖.": "signup_end",
        "成交时间": "deal_time", "竞得单位": "winner", "总用地面积.平方米.": "site_area",
        "容积率": "far", "最大容积率": "max_far", "住宅面积.平方米.": "res_area",
        "商业面积.平方米.": "com_area", "总建筑面积.平方米.": "gfa", "起始价": "start_price",
        "成交价": "deal_price", "建筑密度": "density", "绿地率": "green",
        "地块详情": "detail_url",
    }),
    "second_hand": ("房管网_房产市场", {
        "日期": "date", "所在区域": "region", "X.二手房住宅.交易套数": "units",
        "X.二手房住宅.交易面积": "area",
    }),
    "land_supply_month": ("土地报告_土地供应_view_2_task", {
        "供应时间": "date", "土地供应宗数": "count", "土地供应面积": "area",
        "土地供应量环比": "change",
    }),
    "land_deal_month": ("土地报告_土地成交_view_2_task", {
        "成交时间": "date", "土地成交宗数": "count", "土地成交面积": "area",
        "土地供应量环比": "change",
    }),
    "land_ratio_month": ("土地报告_土地供销比_view_2_task", {
        "日期": "date", "供销比": "supply_deal_ratio",
    }),
    "land_amount_month": ("土地报告_土地成交金额环比_view_2_task", {
        "成交时间": "date", "成交金额": "value", "上一期成交金额": "previous",
        "成交金额环比": "change",
    }),
    "land_floor_month": ("土地报告_土地楼面价环比_view_2_task", {
        "成交日期": "date", "楼面价": "value", "上一期楼面价": "previous",
        "楼面价环比": "change",
    }),
    "land_floor_pair_month": ("土地报告_月度土地楼面价与涉宅土地楼面价对比_view_2_task", {
        "日期": "date", "楼面价": "floor_price", "涉宅楼面价": "res_floor_price",
    }),
    "land_residential_month": ("土地报告_涉宅土地供销比_view_2_task", {
        "日期": "date", "供应": "supply", "成交": "deal", "供销比": "ratio",
    }),
    "land_floor_pair_year": ("土地报告_年度土地楼面价与涉宅土地楼面价对比_view_2_task", {
        "日期": "date", "楼面价": "floor_price", "涉宅楼面价": "res_floor_price",
    }),
    "land_residential_year": ("土地报告_年度涉宅土地供销比_view_2_task", {
        "日期": "date", "供应": "supply", "成交": "deal", "供销比": "ratio",
    }),
    "land_district_amount": ("土地报告_各区域经营性用地成交总额环比情况_view_2_task", {
        "成交时间": "date", "所属行政区": "district", "成交金额": "value",
        "上一期成交金额": "previous", "成交金额环比": "change",
    }),
    "land_district_mean": ("土地报告_各区域经营性用地成交额均价环比情况_view_2_task", {
        "成交时间": "date", "所属行政区": "district", "成交金额": "value",
        "上一期成交金额": "previous", "成交额均价环比": "change",
    }),
    "money": ("m2", {"M1数量.亿元.": "m1", "M2数量.亿元.": "m2"}),
    "reserve_ratio": ("deposit_reserve_ratio", {
        "大型金融机构": "large", "中小金融机构": "small_medium",
    }),
    "lending_rate": ("benchmark_lending_rate", {"贷款基准利率...": "rate"}),
    "income": ("per_capita_disposable_income", {
        "城镇常住居民人均可支配收入": "urban", "农村常住居民人均可支配收入": "rural",
    }),
    "income_detail": ("per_capita_disposable_income_detail", {
        "区域": "region", "城镇常住居民人均可支配收入.元.": "urban",
    }),
    "cpi_pair": ("cn_wz_cpi", {"全国CPI": "national", "温州市CPI": "city"}),
    "cpi": ("cpi", {"房地产贷款量.亿元.": "loan", "货币供应量.亿元.": "m2"}),
    "city_population": ("wenzhou_population", {
        "人口.万人.": "population", "城镇人口比重": "urban_share", "GDP.亿元.": "gdp",
    }),
    "people": ("people", {
        "区域": "region", "人口": "population", "城镇人口": "urban_pop", "GDP": "gdp",
    }),
}

SCHEMAS: dict[str, T.StructType] = {
    "sale_daily": SALE_DAILY,
    "supply_raw": SUPPLY_RAW,
    "promo": PROMO,
    "room_price": ROOM_PRICE,
    "project_info": PROJECT_INFO,
    "deal_list": DEAL_LIST,
    "history_supply": HISTORY_SUPPLY,
    "region_ratio": REGION_RATIO,
    "region_band_ratio": REGION_BAND_RATIO,
    "region_band_stock": REGION_BAND_STOCK,
    "project_name": PROJECT_NAME,
    "room": ROOM,
    "land": LAND,
    "second_hand": SECOND_HAND,
    "land_supply_month": LAND_MONTH,
    "land_deal_month": LAND_MONTH,
    "land_ratio_month": LAND_RATIO_MONTH,
    "land_amount_month": LAND_CHANGE,
    "land_floor_month": LAND_CHANGE,
    "land_floor_pair_month": LAND_PRICE_PAIR,
    "land_residential_month": LAND_SUPPLY_DEAL,
    "land_floor_pair_year": LAND_PRICE_PAIR,
    "land_residential_year": LAND_SUPPLY_DEAL,
    "land_district_amount": LAND_DISTRICT_CHANGE,
    "land_district_mean": LAND_DISTRICT_CHANGE,
    "money": MONEY,
    "reserve_ratio": RESERVE_RATIO,
    "lending_rate": LENDING_RATE,
    "income": INCOME,
    "income_detail": INCOME_DETAIL,
    "cpi_pair": CPI_PAIR,
    "cpi": CPI,
    "city_population": CITY_POPULATION,
    "people": PEOPLE,
}

# tables that only this library writes come on top
STORED: dict[str, T.StructType] = SCHEMAS | {"parcels_by_deal": PARCELS, "parcels_by_listing": PARCELS}

# --- fixed values: column headings of the six report tables -----------------
HEADINGS: dict[str, dict[str, str]] = {
    "land_query_table": {
        "status": "地块状态", "district": "区域", "parcel_name": "地块名称",
        "parcel_no": "地块编号", "location": "地块位置", "land_use": "土地用途",
        "list_start": "挂牌时间", "list_end": "挂牌截止时间", "terminate_date": "终止时间",
        "deal_time": "成交时间", "winner": "竞得单位", "site_area_label": "占地面积(亩)",
        "far": "容积率", "res_area": "住宅面积(㎡)", "com_area": "商业面积(㎡)",
        "gfa": "建筑面积(㎡)", "start_price": "挂牌价(万元)", "deal_price": "出让价(万元)",
        "density": "建筑密度", "green": "绿地率", "list_floor_price": "挂牌楼面价(元/㎡)",
        "deal_floor_price": "出让楼面价(元/㎡)",
    },
    "land_open_listings": {
        "district": "区域", "parcel_name": "地块名称", "parcel_no": "地块编号",
        "land_use": "土地用途", "list_start": "挂牌开始时间", "list_end": "挂牌截止时间",
        "site_area": "占地面积(㎡)", "start_price": "挂牌金额(万元)",
    },
    "room_table": {
        "promo_name": "项目名称", "record_name": "项目备案名", "sale_date": "销售日期",
        "building": "幢名", "room_no": "室号", "status": "属性", "area": "总面积(㎡)",
        "unit_price": "单价(元/㎡)", "total_price": "总价(元)",
    },
    "deal_table": {
        "promo_name": "项目名称", "record_name": "项目备案名", "region": "区域",
        "units": "成交套数", "area": "成交面积(㎡)", "price_label": "参考毛坯均价(元/㎡)",
    },
    "supply_table": {
        "promo_name": "项目名称", "record_name": "项目备案名", "region": "区域",
        "supply": "供应套数", "for_sale": "在售套数", "on_sale_area": "在售面积(㎡)",
        "sell_through_label": "去化率", "res_price_label": "住宅均价(元/㎡)",
        "com_price_label": "商业均价(元/㎡)",
    },
    "new_openings": {
        "record_name": "项目名称", "promo_name": "项目推广名", "region": "区域",
        "open_date": "开盘日期", "units": "套数", "area": "面积(㎡)",
    },
}

# --- fixed values: headings and units of the one-row reports ----------------
FIGURES: dict[str, dict[str, tuple[str, str]]] = {
    "land_query_kpis": {
        "listed_count": ("挂牌宗数", "宗"), "listed_area": ("挂牌面积", "万㎡"),
        "listed_floor_price": ("挂牌楼面价", "元/㎡"), "dealt_count": ("出让宗数", "宗"),
        "dealt_area": ("出让面积", "万㎡"), "dealt_floor_price": ("出让楼面价", "元/㎡"),
    },
    "land_supply_month_kpis": {
        "count": ("土地挂牌宗数", "宗"), "area": ("土地挂牌面积", "万㎡"),
        "change_pct": ("土地挂牌量环比", "%"),
    },
    "land_deal_month_kpis": {
        "count": ("土地出让宗数", "宗"), "area": ("土地出让面积", "万㎡"),
        "change_pct": ("土地出让量环比", "%"),
    },
    "room_kpis": {
        "supplied": ("房源供应量", "套"), "sold": ("成交套数", "套"),
        "sold_area": ("成交面积", "万㎡"),
    },
    "deal_kpis": {
        "units": ("成交套数", "套"), "area": ("成交面积", "万㎡"),
        "price": ("成交均价", "万元/㎡"),
    },
    "supply_kpis": {
        "supply": ("房源总供应量", "套"), "for_sale": ("在售套数", "套"),
        "on_sale_area": ("在售面积", "万㎡"),
    },
    "supply_sale_kpis": {
        "supply": ("房源总供应量", "套"), "for_sale": ("房源在售总量", "套"),
        "on_sale_area": ("房源在售总面积", "万/㎡"), "sold_units": ("房源成交总量", "套"),
        "sold_area": ("房源成交总面积", "万/㎡"),
    },
    "stock_kpis": {"stock": ("库存量", "套"), "stock_area": ("库存面积", "万㎡")},
    "money_latest": {"m1": ("上月M1数据", "万亿元"), "m2": ("上月M2数据", "万亿元")},
    "lending_latest": {"rate_pct": ("最新贷款基准利率", "%")},
    "reserve_latest": {
        "large_pct": ("存款准备金率 : 大型金融机构", "%"),
        "small_medium_pct": ("存款准备金率 : 中小金融机构", "%"),
    },
    "income_latest": {
        "urban": ("最新温州城镇人均可支配收入", "万元"),
        "rural": ("最新温州农村人均可支配收入", "万元"),
    },
    "cpi_latest": {
        "national": ("最新全国居民消费价格指数(CPI)", ""),
        "city": ("最新温州市居民消费价格指数", ""),
    },
    "city_population_kpis": {
        "population": ("温州市人口总量", "万人"), "urban_pct": ("温州市城镇人口比重", "%"),
    },
    "gdp_kpis": {
        "gdp": ("2017年温州市GDP总量", "亿元"), "gdp_per_head": ("2017年温州市人均GDP", "元"),
    },
}
