"""Every operator by name: its module, its kernel, and aliases. `cv.<name>` calls a kernel on arrays."""

from __future__ import annotations

from collections.abc import Callable

from .kernels import dense, detect, features, motion, photo, shapes
from .sources import codecs, video

MODULES: dict[str, tuple[tuple, str]] = {
    "imgcodecs": ((codecs,), "imread imwrite imdecode imencode"),
    "vid": ((video, motion), "video_capture extract_images_from_video extract_video_from_images background_subtract_mog2 calc_optical_flow_pyr_lk calc_optical_flow_farneback createBackgroundSubtractorKNN meanShift CamShift KalmanFilter DISOpticalFlow_create SparsePyrLKOpticalFlow_create buildOpticalFlowPyramid"),
    "transforms": ((dense,), "apply_negative apply_log apply_gamma rgb_to_gray apply_threshold apply_threshold_binary_inv apply_threshold_trunc apply_threshold_tozero apply_threshold_tozero_inv apply_threshold_triangle apply_otsu_with_mode rgb_to_cmy apply_frequency_filter adaptive_threshold"),
    "color_convert": ((dense,), "rgb_to_hsv rgb_to_hls rgb_to_ycrcb rgb_to_xyz rgb_to_lab rgb_to_luv bgr_to_rgb gray_to_rgb rgb_to_yuv cvtColor"),
    "arithmetic": ((dense,), "add_images sub_images add_weighted bitwise_and bitwise_or bitwise_not bitwise_xor apply_multiply apply_divide absdiff apply_min apply_max apply_pow apply_sqrt apply_exp apply_log_op apply_normalize convert_scale_abs in_range apply_lut split_channels merge_channels mix_channels count_non_zero mean_std_dev min_max_loc calculate_phase calculate_magnitude cart_to_polar polar_to_cart"),
    "histogram": ((dense,), "hist_equalize_rgb hist_equalize_gray hist_spec_rgb hist_spec_gray apply_otsu_threshold calc_hist compare_hist match_template calc_back_project emd_1d"),
    "filters": ((dense,), "median_filter laplacian_filter pyr_down pyr_up"),
    "smoothing": ((dense,), "apply_filter2d apply_blur apply_gaussian_blur apply_median_blur apply_bilateral_filter"),
    "gradient": ((dense,), "apply_sobel apply_scharr apply_laplacian"),
    "edge_detection": ((dense,), "apply_canny harris_corner shi_tomasi_corners hough_lines hough_circles"),
    "morphological": ((dense,), "apply_erosion apply_dilation opening apply_closing morphological_gradient top_hat black_hat"),
    "geometric": ((dense,), "apply_resize apply_translate apply_rotate apply_warp apply_warp_affine get_rotation_matrix_2d get_affine_transform get_perspective_transform apply_flip apply_transpose apply_remap invert_affine_transform apply_linear_polar apply_log_polar"),
    "contours": ((shapes,), "find_contours draw_contours contour_area arc_length bounding_rect min_area_rect min_enclosing_circle fit_ellipse convex_hull convexity_defects approx_poly_dp moments hu_moments match_shapes is_contour_convex point_polygon_test"),
    "segmentation": ((shapes,), "connected_components connected_components_with_stats distance_transform flood_fill watershed grab_cut"),
    "drawing": ((shapes,), "line rectangle circle ellipse polylines fill_poly arrowed_line put_text"),
    "features2d": ((features,), "fast_detect good_features_to_track orb_detect_and_compute sift_detect_and_compute brisk_detect_and_compute akaze_detect_and_compute mser_detect simple_blob_detect bf_match knn_match drawKeypoints drawMatches findHomography flann_match KeyPoint DMatch"),
    "misc_imgproc": ((dense, motion, shapes), "get_structuring_element morphology_ex canny_l2 corner_sub_pix hough_lines_p line_segment_detector corner_eigen_vals_and_vecs pre_corner_detect integral sqr_box_filter sep_filter_2d get_gabor_kernel gaussian_blur_border"),
    "objdetect": ((detect,), "CascadeClassifier HOGDescriptor QRCodeDetector groupRectangles"),
    "photo": ((photo,), "inpaint fastNlMeansDenoising fastNlMeansDenoisingColored seamlessClone colorChange illuminationChange textureFlattening decolor createTonemap createMergeMertens createCalibrateDebevec createMergeDebevec edgePreservingFilter detailEnhance pencilSketch stylization"),
    "calib3d": ((photo,), "calibrateCamera findChessboardCorners undistort solvePnP stereoCalibrate stereoRectify reprojectImageTo3D findEssentialMat findFundamentalMat decomposeHomographyMat triangulatePoints"),
    "dnn": ((detect,), "readNet readNetFromONNX readNetFromTensorflow blobFromImage NMSBoxes Net"),
}

ALIASES = {
    "multiply": "apply_multiply", "divide": "apply_divide", "min": "apply_min", "max": "apply_max", "normalize": "apply_normalize", "split": "split_channels", "merge": "merge_channels", "mixChannels": "mix_channels", "inRange": "in_range", "LUT": "apply_lut", "countNonZero": "count_non_zero", "meanStdDev": "mean_std_dev", "minMaxLoc": "min_max_loc",
    "resize": "apply_resize", "warpAffine": "apply_warp_affine", "getRotationMatrix2D": "get_rotation_matrix_2d", "getAffineTransform": "get_affine_transform", "getPerspectiveTransform": "get_perspective_transform", "remap": "apply_remap", "flip": "apply_flip", "transpose": "apply_transpose", "invertAffineTransform": "invert_affine_transform", "linearPolar": "apply_linear_polar", "logPolar": "apply_log_polar", "grabCut": "grab_cut",
}

CLASSES = ("KeyPoint", "DMatch", "Net")


def _find(modules: tuple, name: str) -> Callable:
    from .kernels import lines

    return next(getattr(m, name) for m in (*modules, lines) if hasattr(m, name))


KERNELS: dict[str, Callable] = {name: _find(mods, name) for mods, names in MODULES.values() for name in names.split()}
KERNELS |= {alias: KERNELS[name] for alias, name in ALIASES.items()}
MODULE_OF = {name: m for m, (_, names) in MODULES.items() for name in names.split()}
MODULE_OF |= {alias: MODULE_OF[name] for alias, name in ALIASES.items()}


def kernel(name: str) -> Callable:
    try:
        return KERNELS[name]
    except KeyError:
        raise ValueError(f"no operator {name}") from None
