"""A small hand-made shop with the edge cases of the customer jobs."""

from datetime import datetime as dt
from decimal import Decimal

from mercantile.sources.retail import RetailTables

LAST = dt(2018, 6, 30, 9, 0)


def shop(spark) -> RetailTables:
    customers = spark.createDataFrame(
        [("a1", "ann", "SP"), ("a2", "ann", "SP"), ("b1", "bob", "RJ"), ("c1", "cat", "RJ"), ("d1", "dan", "SP"), ("e1", "eve", "MG")],
        "customer_id string, customer_unique_id string, customer_state string",
    )
    # order, account, status, purchase, approval, delivery, promise
    orders = spark.createDataFrame(
        [
            ("o1", "a1", "delivered", dt(2018, 1, 5, 10), None, dt(2018, 1, 9), dt(2018, 1, 20)),
            ("o2", "a2", "delivered", dt(2018, 3, 2, 8), dt(2018, 3, 1), dt(2018, 4, 1, 12), dt(2018, 3, 20)),
            ("o3", "b1", "delivered", dt(2018, 4, 1, 23, 59), dt(2018, 4, 2), dt(2018, 4, 20), None),  # 90 days before
            ("o4", "c1", "delivered", dt(2018, 3, 31, 0, 1), dt(2018, 4, 1), dt(2018, 4, 5), dt(2018, 4, 5)),  # 91 days
            ("o5", "d1", "delivered", LAST, LAST, LAST, LAST),
            ("o6", "e1", "delivered", dt(2018, 7, 2), None, None, dt(2018, 7, 20)),  # not delivered yet
            ("o7", "b1", "canceled", dt(2018, 6, 1), None, None, None),
        ],
        """order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz,
        order_approved_at timestamp_ntz, order_delivered_customer_date timestamp_ntz,
        order_estimated_delivery_date timestamp_ntz""",
    )
    money = Decimal
    payments = spark.createDataFrame(
        [
            ("o1", 1, "credit_card", 3, money("100.10")),
            ("o1", 2, "voucher", 1, money("0.20")),
            ("o2", 1, "boleto", 1, money("50.00")),
            ("o3", 1, "credit_card", None, money("0.00")),
            ("o5", 1, "credit_card", 2, money("10.05")),
            ("o7", 1, "boleto", 1, money("99.00")),
        ],
        "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value decimal(18,2)",
    )
    reviews = spark.createDataFrame(
        [
            ("r1", "o1", 5, dt(2018, 1, 10)),
            ("r2", "o1", 2, dt(2018, 1, 12)),
            ("r3", "o2", 4, dt(2018, 4, 2)),
            ("r4", "o4", None, dt(2018, 4, 6)),
            ("r5", "o5", 1, dt(2018, 7, 1)),
        ],
        "review_id string, order_id string, review_score int, review_creation_date timestamp_ntz",
    )
    products = spark.createDataFrame(
        [("p1", "toys", 10), ("p2", None, None), ("p3", "garden", 3)],
        "product_id string, product_category_name string, product_weight_g int",
    )
    items = spark.createDataFrame(
        [
            ("o1", "p1", "s1", money("60.00"), money("6.00")),
            ("o1", "p1", "s1", money("30.00"), money("4.00")),
            ("o1", "p2", "s2", money("10.00"), money("1.00")),
            ("o2", "p2", "s1", money("40.00"), money("10.00")),
            ("o6", "p3", "s2", money("500.00"), money("1.00")),
        ],
        "order_id string, product_id string, seller_id string, price decimal(18,2), freight_value decimal(18,2)",
    )
    sellers = spark.createDataFrame([("s1", "SP"), ("s2", "RJ")], "seller_id string, seller_state string")
    translation = spark.createDataFrame(
        [("toys", "toys_en")], "product_category_name string, product_category_name_english string"
    )
    return RetailTables(
        customers=customers,
        orders=orders,
        payments=payments,
        reviews=reviews,
        products=products,
        order_items=items,
        sellers=sellers,
        category_translation=translation,
    )
