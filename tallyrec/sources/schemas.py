"""Declared schemas of the domain tables."""

from __future__ import annotations

TABLES = {
    "events": "event_id long, occurred_at timestamp, event_type string, user_id long, session_key string, product_id long, source string, device_type string, recommendation_id long, event_metadata string",
    "products": "id long, sku string, name string, description string, category_id string, brand_id string, price double, cost double, price_band string, attributes string, tags string, stock_quantity int, rating_average double, rating_count long, view_count long, purchase_count long, released_at date, is_active boolean, category_path string, repeat_rate double",
    "categories": "id string, name string, slug string, parent_id string, depth int, path string",
    "brands": "id string, name string, slug string, price_tier string",
    "users": "id long, email string, full_name string, role string, country string, signup_source string, primary_device string, segment string, preferred_price_band string, onboarding_categories string, created_at date",
    "user_sessions": "id long, session_key string, user_id long, device_type string, started_at timestamp, ended_at timestamp, event_count int, converted boolean",
    "orders": "id long, user_id long, session_id long, order_number string, status string, subtotal double, discount_total double, shipping_total double, grand_total double, currency string, placed_at timestamp",
    "order_items": "id long, order_id long, product_id long, variant_id long, quantity int, unit_price double, discount double, line_total double, source_recommendation_id long",
}
#: JSON columns and what they hold.
JSON_COLUMNS = {
    ("products", "attributes"): "map<string,string>",
    ("products", "tags"): "array<string>",
    ("users", "onboarding_categories"): "array<string>",
    ("events", "event_metadata"): "map<string,string>",
}
