"""Column orders that files of the engine have."""

#: Columns of the count-error table and its CSV file, in order.
COUNT_ERRORS = ["row_type", "image", "image_path", "class_id", "class_name", "gt_count", "pred_count", "error", "abs_error", "squared_error", "exact", "inference_ms", "end_to_end_ms"]
