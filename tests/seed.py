"""Seed-shaped fixture: the reference's sample community as test rows (ids are insert order).

Long free texts are shortened; every value the goldens depend on is kept.
"""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal as D

from hearth import schemas as S

T0 = datetime(2026, 6, 1, 0, 0, 0)

# fixed values: seed rows (insert order gives the ids)
BUILDINGS = [("A栋", 18, "小区东侧"), ("B栋", 18, "小区西侧"), ("C栋", 12, "小区北侧"), ("D栋", 6, "小区南侧（多层）")]
UNITS = [(1, "1单元", 18), (1, "2单元", 18), (2, "1单元", 18), (2, "2单元", 18),
         (3, "1单元", 12), (3, "2单元", 12), (4, "1单元", 6), (4, "2单元", 6)]
ROOMS = [(1, "101", "89.50", "住宅", "已入住"), (1, "102", "105.30", "住宅", "已入住"),
         (1, "201", "89.50", "住宅", "已入住"), (1, "202", "120.00", "住宅", "空置"),
         (2, "101", "95.80", "住宅", "已入住"), (2, "102", "110.60", "住宅", "已入住"),
         (3, "101", "88.00", "住宅", "已入住"), (3, "102", "100.20", "住宅", "空置"),
         (4, "101", "78.50", "住宅", "已入住"), (5, "101", "130.00", "住宅", "已入住"),
         (5, "102", "125.50", "住宅", "已入住"), (6, "101", "115.80", "住宅", "空置"),
         (7, "101", "92.00", "住宅", "已入住"), (7, "102", "85.60", "住宅", "已入住"),
         (8, "101", "88.30", "住宅", "已入住"), (1, "S01", "45.00", "商铺", "已入住"),
         (2, "S02", "60.00", "商铺", "已入住")]
RESIDENTS = [(1, "张伟", "男", "110101199001011234", "业主", "2020-03-15"),
             (2, "李娜", "女", "110101198805062345", "业主", "2019-08-20"),
             (3, "王强", "男", "110101199203153456", "业主", "2021-01-10"),
             (5, "赵敏", "女", "110101198507204567", "业主", "2018-06-01"),
             (6, "刘洋", "男", "110101199509105678", "业主", "2022-05-18"),
             (7, "陈静", "女", "110101198711256789", "业主", "2020-09-01"),
             (9, "杨帆", "男", "110101199306187890", "业主", "2023-02-14"),
             (10, "周涛", "男", "110101198001058901", "业主", "2017-11-20"),
             (11, "吴芳", "女", "110101199108129012", "业主", "2019-04-10"),
             (13, "郑浩", "男", "110101198604230123", "业主", "2021-07-01"),
             (14, "孙丽", "女", "110101199412151234", "家属", "2022-01-01"),
             (15, "马超", "男", "110101198809302345", "业主", "2020-10-15"),
             (16, "钱进", "男", "110101197906153456", "业主", "2021-03-20"),
             (17, "韩雪", "女", "110101199702084567", "租客", "2024-01-01"),
             (2, "李小明", "男", "110101198806015678", "家属", "2019-08-20")]
SPACES = [("A-001", "地下一层A区", "普通", "已租", "300.00"), ("A-002", "地下一层A区", "普通", "已租", "300.00"),
          ("A-003", "地下一层A区", "普通", "空闲", "300.00"), ("A-004", "地下一层A区", "大型", "已租", "400.00"),
          ("A-005", "地下一层A区", "大型", "空闲", "400.00"), ("B-001", "地下一层B区", "普通", "已租", "300.00"),
          ("B-002", "地下一层B区", "普通", "空闲", "300.00"), ("B-003", "地下一层B区", "充电", "已租", "500.00"),
          ("B-004", "地下一层B区", "充电", "空闲", "500.00"), ("B-005", "地下一层B区", "普通", "已售", "0"),
          ("C-001", "地下二层", "普通", "空闲", "300.00"), ("C-002", "地下二层", "普通", "已租", "300.00"),
          ("C-003", "地下二层", "大型", "维修中", "0"), ("C-004", "地下二层", "普通", "空闲", "300.00")]
VEHICLES = [(1, 1, "京A12345", "轿车", "白色"), (2, 2, "京B67890", "SUV", "黑色"), (4, 4, "京C11111", "轿车", "银色"),
            (5, 6, "京D22222", "电动车", "白色"), (8, 8, "京E33333", "电动车", "蓝色"),
            (10, None, "京F44444", "轿车", "红色"), (12, 12, "京G55555", "SUV", "灰色")]
CATEGORIES = [("物业管理费", "月", "按面积", "2.5000"), ("停车管理费", "月", "固定", "300.0000"),
              ("垃圾处理费", "月", "固定", "15.0000"), ("公共维修基金", "月", "按面积", "0.5000"),
              ("电梯维护费", "月", "固定", "30.0000")]
STAFF = [("王建国", "男", "经理", "8000.00", "2015-03-01", "在职"), ("张大明", "男", "维修工", "5500.00", "2018-06-15", "在职"),
         ("李铁柱", "男", "维修工", "5000.00", "2020-01-10", "在职"), ("赵安全", "男", "保安", "4500.00", "2019-05-20", "在职"),
         ("钱美丽", "女", "保洁", "4000.00", "2021-03-01", "在职"), ("孙小飞", "男", "保安", "4500.00", "2022-08-01", "在职"),
         ("周清洁", "女", "保洁", "4000.00", "2020-07-15", "离职")]
ORDERS = [(1, 2, "高", "处理中", "2026-06-15 09:30:00"), (3, 3, "中", "待处理", "2026-06-18 14:20:00"),
          (5, 2, "紧急", "处理中", "2026-06-20 08:00:00"), (7, None, "中", "待处理", "2026-06-21 10:15:00"),
          (10, 3, "中", "已完成", "2026-06-01 11:00:00"), (12, None, "高", "待处理", "2026-06-22 16:30:00"),
          (14, 2, "中", "处理中", "2026-06-19 19:45:00"), (9, None, "紧急", "待处理", "2026-06-22 07:30:00")]
COMPLAINTS = [(1, "投诉", "处理中", "2026-06-10 22:00:00"), (4, "建议", "已解决", "2026-05-15 10:00:00"),
              (6, "建议", "处理中", "2026-06-18 15:30:00"), (8, "投诉", "已解决", "2026-06-05 09:00:00"),
              (11, "建议", "待处理", "2026-06-20 12:00:00"), (13, "投诉", "处理中", "2026-06-17 20:30:00")]
ANNOUNCEMENTS = [(False, "2026-06-20 09:00:00"), (True, "2026-06-18 10:00:00"), (True, "2026-06-23 08:00:00"),
                 (False, "2026-06-15 14:00:00"), (False, "2026-06-22 16:00:00")]
VISITS = [(1, "维修", "2026-06-15 10:00:00", "2026-06-15 12:00:00"), (2, "探访", "2026-06-18 14:00:00", "2026-06-18 17:30:00"),
          (5, "快递", "2026-06-20 09:30:00", "2026-06-20 09:45:00"), (7, "外卖", "2026-06-21 12:10:00", "2026-06-21 12:20:00"),
          (10, "探访", "2026-06-20 15:00:00", None), (12, "商务", "2026-06-22 10:00:00", "2026-06-22 11:30:00"),
          (1, "探访", "2026-06-23 08:00:00", None)]
FEES = [(1, 1, "223.75", "2026-05", "已缴"), (1, 3, "15.00", "2026-05", "已缴"), (1, 5, "30.00", "2026-05", "已缴"),
        (2, 1, "263.25", "2026-05", "已缴"), (2, 3, "15.00", "2026-05", "已缴"), (3, 1, "223.75", "2026-05", "逾期"),
        (3, 3, "15.00", "2026-05", "逾期"), (4, 1, "249.50", "2026-06", "待缴"), (4, 2, "400.00", "2026-06", "待缴"),
        (4, 3, "15.00", "2026-06", "待缴"), (5, 1, "276.50", "2026-06", "待缴"), (5, 2, "300.00", "2026-06", "已缴"),
        (5, 3, "15.00", "2026-06", "待缴"), (6, 1, "250.00", "2026-06", "待缴"), (6, 3, "15.00", "2026-06", "待缴"),
        (7, 1, "220.00", "2026-06", "待缴"), (7, 3, "15.00", "2026-06", "待缴"), (8, 1, "196.25", "2026-06", "待缴"),
        (8, 2, "500.00", "2026-06", "待缴"), (8, 3, "15.00", "2026-06", "待缴"), (9, 1, "325.00", "2026-06", "待缴"),
        (10, 1, "313.75", "2026-06", "待缴"), (10, 3, "15.00", "2026-06", "待缴"), (11, 1, "289.00", "2026-06", "待缴"),
        (12, 1, "230.00", "2026-06", "待缴"), (12, 2, "300.00", "2026-06", "待缴"), (12, 3, "15.00", "2026-06", "待缴"),
        (13, 1, "214.00", "2026-06", "待缴"), (14, 1, "220.75", "2026-06", "待缴"), (14, 2, "300.00", "2026-06", "待缴"),
        (14, 3, "15.00", "2026-06", "待缴")]


def _ts(s):
    return None if s is None else datetime.fromisoformat(s)


def _d(s):
    return None if s is None else date.fromisoformat(s)


def seed_rows() -> dict[str, list[tuple]]:
    return {
        "buildings": [(i, n, f, a, T0) for i, (n, f, a) in enumerate(BUILDINGS, 1)],
        "units": [(i, b, u, f, T0) for i, (b, u, f) in enumerate(UNITS, 1)],
        "rooms": [(i, u, r, D(a), ty, st, T0) for i, (u, r, a, ty, st) in enumerate(ROOMS, 1)],
        "residents": [(i, r, n, g, f"138001380{i:02d}", c, rel, _d(m), T0)
                      for i, (r, n, g, c, rel, m) in enumerate(RESIDENTS, 1)],
        "parking_spaces": [(i, no, a, ty, st, D(p), T0) for i, (no, a, ty, st, p) in enumerate(SPACES, 1)],
        "vehicles": [(i, r, s, p, ty, c, T0) for i, (r, s, p, ty, c) in enumerate(VEHICLES, 1)],
        "fee_categories": [(i, n, cy, m, D(p), None) for i, (n, cy, m, p) in enumerate(CATEGORIES, 1)],
        "fee_records": [(i, r, c, D(a), D("0"), per, st, date.fromisoformat(per + "-25"), None, T0)
                        for i, (r, c, a, per, st) in enumerate(FEES, 1)],
        "staff": [(i, n, g, f"139001390{i:02d}", ro, D(sa), _d(h), st, T0)
                  for i, (n, g, ro, sa, h, st) in enumerate(STAFF, 1)],
        "repair_orders": [(i, r, s, f"order {i}", None, None, p, st, _ts(c), None)
                          for i, (r, s, p, st, c) in enumerate(ORDERS, 1)],
        "complaints": [(i, r, f"complaint {i}", "text", ty, st, None, _ts(c), None)
                       for i, (r, ty, st, c) in enumerate(COMPLAINTS, 1)],
        "announcements": [(i, f"notice {i}", "text", "通知", "物业服务中心", top, _ts(c))
                          for i, (top, c) in enumerate(ANNOUNCEMENTS, 1)],
        "visitor_records": [(i, r, f"visitor {i}", None, p, _ts(a), _ts(b), None)
                            for i, (r, p, a, b) in enumerate(VISITS, 1)],
    }


def seed_tables(spark) -> dict:
    rows = seed_rows()
    return {n: spark.createDataFrame(rows[n], S.TABLES[n].spark_schema) for n in S.TABLES}
