"""rippleframe: wavelet-image analytics and data processing on Spark DataFrames."""
