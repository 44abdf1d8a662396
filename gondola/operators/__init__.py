"""Reports, data quality, demand, stock, segmentation and dashboard operators."""
