"""Declared schemas: nothing is inferred from files."""

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

MODEL = {
    "customers": "customer_id bigint, name string, email string, city string, age int, gender string",
    "products": "sku string, product_id bigint, category string, subcategory string, base_price decimal(12,2)",
    "product_descriptions": "sku string, description string, value string",
    "offers": "merchant_id string, sku string, inventory int, offer_price decimal(12,2), listing_date date",
    "views": "http_request_id bigint, timestamp timestamp_ntz, sku string, num_offers int, instock boolean, price_viewed decimal(12,2), customer_id bigint",
    "instock_events": "http_request_id bigint, sku string, reason string",
    "sales": "order_id bigint, customer_id bigint, merchant_id string, sku string, quantity int, unit_price decimal(12,2), "
             "order_timestamp timestamp_ntz, fulfilment_status string",
    "ratings": "rating_id bigint, customer_id bigint, sku string, rating int, review string, rating_timestamp timestamp_ntz",
    "inventory_events": "timestamp timestamp_ntz, merchant_id string, sku string, event_type string, quantity int, reason string, new_balance bigint",
    "stock_checks": "merchant_id string, sku string, requested_qty int, available_qty int, can_fulfill boolean, stock_status string",
    "browsing_sessions": "session_id bigint, customer_id bigint, start_time timestamp_ntz, end_time timestamp_ntz, pages_viewed int, "
                         "categories_browsed array<string>, session_type string",
    "cart_events": "cart_id bigint, customer_id bigint, sku string, quantity int, price decimal(12,2), timestamp timestamp_ntz, event_type string, session_id bigint",
}
