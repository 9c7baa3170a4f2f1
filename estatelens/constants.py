"""Fixed values of the data model.

The texts and numbers below have to be exactly these for results to agree
with the source tables; they are data, not logic.
"""

# --- fixed values: category of a sale, anything else is OTHER ---------------
RESIDENTIAL = "住宅"
COMMERCIAL = "商业"
OTHER = "其他"

SALE_CATEGORY = {
    RESIDENTIAL: ["住宅", "成套住宅", "成 住宅", "成住宅", "成  住宅", "别墅"],
    COMMERCIAL: [
        "宿舍", "商业", "产权式酒店", "商铺", "酒店", "商店", "公寓式酒店", "餐饮",
        "商场", "商贸", "商务设施", "商业附房", "宾馆", "金融", "饭店", "农贸市场",
    ],
}

# --- fixed values: category of a priced room, anything else is RESIDENTIAL --
ROOM_CATEGORY = {
    OTHER: [
        "厂房", "办公", "办公用房", "车位", "销售展示厅", "仓库", "办公室", "工业", "车库",
        "创客空间", "农具间", "物业01", "物业02", "物业经营用房", "发电机房", "其他",
        "消防控制室", "开闭所", "生产车间", "弱电机房", "消控室", "物业用房", "不可售",
        "不在项目内", "洗手间", "物业", "产品展示中心（工业）",
    ],
    COMMERCIAL: [
        "商业", "商住房", "酒店套房", "店面", "商铺", "产权式酒店", "农贸市场", "度假屋",
        "[商业]餐饮", "[酒店]客房", "[酒店]样板房", "商务酒店", "宿舍",
    ],
}

# --- fixed values: size bands of one home, in square metres -----------------
BAND_EDGES = (90, 120, 144, 180)
BAND_LABELS = (
    "小于90㎡面积",
    "90-120㎡面积",
    "120-144㎡面积",
    "144-180㎡面积",
    "180㎡以上面积",
)

# --- fixed values: land uses ------------------------------------------------
RESIDENTIAL_USES = [
    "住宿餐饮用地",
    "养老服务用地",
    "城镇住宅用地(普通商品房)",
    "普通商品住房用地",
    "旅馆用地",
]
PUBLIC_USES = [
    "公共设施用地",
    "公用设施用地",
    "养老服务用地",
    "医卫慈善用地",
    "教育用地",
    "港口码头用地",
    "社会福利用地",
    "科教用地",
    "街巷用地",
]

# --- fixed values: places ---------------------------------------------------
CITY_PROPER = "温州市(本级)"
TOTAL_REGIONS = ["全市", "市区"]
LOCATION_PATCHES = {"javascript:goRes('13752','01');": "瓯海区娄桥街道杆南村"}

# --- fixed values: states and labels ----------------------------------------
SOLD_STATUSES = ["已售", "已登记", "已认购", "安置房"]
MISSING = "暂无数据"
NAME_SUFFIX = "（详细信息）"
EARLIEST_DATE_TEXT = "1999/00/01"

# --- fixed values: bounds used when a size box is left empty ----------------
LAND_AREA_BOUNDS = (0, 100_000_000)
HOME_AREA_BOUNDS = (0, 50_000)

# --- fixed values: units ----------------------------------------------------
TEN_THOUSAND = 10_000
SQUARE_METRES_PER_THREE_MU = 2000
