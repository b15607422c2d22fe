"""Column types and primary keys of the star schema."""

from __future__ import annotations

# Tables, columns and keys of the warehouse model.
SCHEMAS = {
    "brands": "brand_id int, name string",
    "categories": "category_id int, category_home string, category_1 string, category_2 string",
    "ingredients_master": "ingredient_id int, name string, ewg_grade string, is_caution boolean",
    "products": "product_code bigint, brand_id int, category_id int, name string, price int, country string, created_at timestamp",
    "product_attributes": "product_code bigint, `group` string, is_functional boolean, price_tier string, price_position string, "
    "item_ph string, whitening boolean, wrinkle_reduction boolean, sunscreen boolean, can_vegan string, can_halal string",
    "product_metrics": "product_code bigint, likes int, shares int, review_count int, engagement_score double, cp_index double, "
    "review_density double, is_god_sung_bi boolean, last_updated date",
    "product_ingredients": "product_code bigint, ingredient_id int, rank int",
    "users": "user_id int, user_masked string, activity_level string, rating_tendency string",
    "reviews": "order_id bigint, product_code bigint, user_id int, write_date date, rating double, text string, image_count int, is_reorder boolean",
    "review_analysis": "order_id bigint, length int, length_category string, sentiment string, sentiment_score double, promo_type string",
    "promotions": "promotion_id int, brand_id int, start_date date, end_date date, description string, event_type string",
}

PRIMARY_KEYS = {
    "brands": ["brand_id"],
    "categories": ["category_id"],
    "ingredients_master": ["ingredient_id"],
    "products": ["product_code"],
    "product_attributes": ["product_code"],
    "product_metrics": ["product_code"],
    "product_ingredients": ["product_code", "ingredient_id"],
    "users": ["user_id"],
    "reviews": ["order_id"],
    "review_analysis": ["order_id"],
    "promotions": ["promotion_id"],
}

LABEL_SCHEMA = (
    "`index` bigint, text string, product_code string, rating double, sentiment string, sentiment_score double, "
    "aspect_labels array<struct<aspect:string,sentiment:string,confidence:double,reason:string>>, evidence string, "
    "summary string, model string, tokens_input bigint, tokens_output bigint, cost double"
)
