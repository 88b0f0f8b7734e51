"""Fixed schemas of the raw inputs."""

BUSINESSES = (
    "business_id string, name string, address string, city string, state string, postal_code string, latitude double, "
    "longitude double, stars double, review_count int, is_open int, categories string, attributes struct<BusinessParking: string>"
)
REVIEWS = "review_id string, user_id string, business_id string, stars double, date string, text string"
CHECKINS = "business_id string, date string"
POIS = "venue_id string, lat string, lon string, category string, country string"
CHECKINS_B = "user_id string, venue_id string, utc_text string, tz_offset_min string"
FRIENDSHIPS = "a string, b string"
TRANSIT_STOPS = "stop_lat double, stop_lon double, " + ", ".join(f"departure_count_dow{i} double" for i in range(1, 8))
INTERACTIONS = "user_id string, business_id string, ts timestamp, interaction_type string, stars double, text_len int"
